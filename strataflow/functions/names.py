"""Well-name columns: canonical form, display form and pattern matching."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITESPACE = " \t\n\r\f\u000b"


def strip(col: Column) -> Column:
    """Trim every kind of ASCII white space, not only blanks."""
    return F.btrim(col, F.lit(WHITESPACE))


def normalize_well_name(col: Column) -> Column:
    """``NO 15/9-F-11 T2`` -> ``15_9_F_11_T2``."""
    bare = F.regexp_replace(strip(col), r"^NO\s+", "")
    return F.regexp_replace(F.translate(bare, "/- ", "___"), "_+", "_")


def display_well_name(col: Column) -> Column:
    """``15_9_F_11_T2`` -> ``15/9-F-11 T2``; names of fewer than three parts stay as they are."""
    parts = F.split(col, "_")
    is_platform = F.get(parts, F.lit(2)) == "F"
    head = F.concat(F.get(parts, F.lit(0)), F.lit("/"), F.get(parts, F.lit(1)), F.lit("-"))
    number = F.when(
        is_platform, F.concat(F.lit("F-"), F.coalesce(F.get(parts, F.lit(3)), F.lit("")))
    ).otherwise(F.get(parts, F.lit(2)))
    first_tail = F.when(is_platform, F.lit(5)).otherwise(F.lit(4))
    tail = F.array_join(F.slice(parts, first_tail, F.greatest(F.size(parts), F.lit(1))), " ")
    shown = F.concat(head, number, F.when(tail != "", F.concat(F.lit(" "), tail)).otherwise(F.lit("")))
    return F.when(F.size(parts) < 3, col).otherwise(shown)


def parent_well(col: Column) -> Column:
    """First four name parts of a well that has more than four, else NULL."""
    parts = F.split(col, "_")
    return F.when(F.size(parts) > 4, F.array_join(F.slice(parts, 1, 4), "_"))


def well_matches(col: Column, pattern: str | None) -> Column:
    """``*`` and ``%`` are wildcards, everything else is literal; None takes every well."""
    if pattern is None:
        return F.lit(True)
    if "*" in pattern or "%" in pattern:
        literal = pattern.replace("\\", "\\\\").replace("_", "\\_")
        return col.like(literal.replace("*", "%"))
    return col == F.lit(pattern)


class WellTables(Mapping):
    """Tables of which only the rows of matching wells are seen; a table without wells is left whole."""

    def __init__(self, tables: Mapping[str, DataFrame], pattern: str):
        self.tables, self.pattern = tables, pattern

    def __getitem__(self, name: str) -> DataFrame:
        df = self.tables[name]
        return df.filter(well_matches(F.col("well"), self.pattern)) if "well" in df.columns else df

    def __iter__(self):
        return iter(self.tables)

    def __len__(self):
        return len(self.tables)


def of_well(tables: Mapping[str, DataFrame], pattern: str | None) -> Mapping[str, DataFrame]:
    """``tables`` cut to the wells that match; all of them for None."""
    return tables if pattern is None else WellTables(tables, pattern)
