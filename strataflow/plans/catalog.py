"""All registered queries; importing a module registers its queries."""

from . import (  # noqa: F401
    benchmark_queries,
    column_queries,
    depth_queries,
    question_queries,
    source_queries,
    text_queries,
    well_queries,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
