"""Report text of a date and depth range."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import of_well, well_matches
from ..functions.predicates import in_dates, in_depths
from ..functions.text import truncate_text
from .ordered import ranked_within, union_all


def _first(rows: DataFrame, kind: str, order: list[Column], k: int | None) -> DataFrame:
    return ranked_within(rows, ["well"], order, k, "ordinal").withColumn("kind", F.lit(kind))


def ddr_narrative(
    tables: Mapping[str, DataFrame],
    date_from: str | None = None,
    date_to: str | None = None,
    depth_from: float | None = None,
    depth_to: float | None = None,
    messages: DataFrame | None = None,
    n_summaries: int | None = 15,
    n_activities: int | None = 15,
    n_messages: int | None = 10,
    chars: int | None = 200,
    well: str | None = None,
) -> DataFrame:
    """Summaries, activity comments and messages of every well, each kind in time order.

    The first ``n_...`` entries of each kind, comments cut to ``chars``; None for all.  ``well`` is a name
    or a pattern (see ``well_matches``).
    """
    tables = of_well(tables, well)
    messages = None if messages is None else messages.filter(well_matches(F.col("well"), well))

    def inside(rows: DataFrame, depth: str) -> DataFrame:
        return rows.filter(
            in_dates(F.col("date"), date_from, date_to) & in_depths(F.col(depth), depth_from, depth_to)
        )

    summaries = inside(tables["ddr_status"], "md_m").filter(F.col("summary_24hr").isNotNull())
    comments = inside(tables["ddr_activities"], "depth_m").filter(F.length("comments") >= 20)
    parts = [
        _first(summaries, "summary", [F.asc_nulls_last("date"), F.asc("report_no")], n_summaries).select(
            "well", "kind", "ordinal", "date", F.col("md_m").alias("depth_m"), "hole_diameter_in",
            F.col("summary_24hr").alias("text"),
            *[F.col(c) for c in ("forecast_24hr",) if c in summaries.columns],
        ),
        _first(
            comments,
            "activity",
            [F.asc_nulls_last("date"), F.asc_nulls_last("start_ts"), F.asc("event_id")],
            n_activities,
        ).select(
            "well", "kind", "ordinal", "date", "depth_m", "activity_code", "state", "state_detail",
            truncate_text(F.col("comments"), chars).alias("text"),
        ),
    ]
    if messages is not None:
        # The upper bound keeps every time of the last day.
        until = None if date_to is None else date_to + "T99"
        kept = messages.filter(
            in_dates(F.col("timestamp"), date_from, until) & in_depths(F.col("md_m"), depth_from, depth_to)
        )
        # Messages only accompany report text of the same well.
        with_text = summaries.select("well").union(comments.select("well")).distinct()
        kept = kept.join(with_text, "well", "left_semi")
        tie = "message_no" if "message_no" in kept.columns else "message_text"
        parts.append(
            _first(kept, "message", [F.asc_nulls_last("timestamp"), F.asc_nulls_last(tie)], n_messages).select(
                "well", "kind", "ordinal", F.substring("timestamp", 1, 10).alias("date"),
                F.col("md_m").alias("depth_m"), F.col("message_text").alias("text"),
            )
        )
    return union_all(parts)
