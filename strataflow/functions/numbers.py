"""Numeric columns: text-to-number cleaning, units, durations, hole sizes, z-scores."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import strip

# Missing-value marks and unit factors of the input formats.
DDR_MISSING_BELOW = -990.0
WITSML_MISSING = (-999.25, -9999.0)
RAD_TO_DEG = 180.0 / math.pi
MPS_TO_MPH = 3600.0
N_TO_KN = 0.001
NM_TO_KNM = 0.001
KGM3_TO_SG = 0.001
CPS_TO_RPM = 60.0
DLS_RAD_M_TO_DEG_30M = RAD_TO_DEG * 30.0

# Nominal hole sizes in inches, largest first, with their section names.
HOLE_SECTIONS = (
    (36.0, 'Conductor (36")'),
    (30.0, 'Conductor (30")'),
    (26.0, 'Surface (26")'),
    (17.5, 'Intermediate (17.5")'),
    (12.25, 'Production (12.25")'),
    (8.5, 'Reservoir (8.5")'),
)

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def to_double(text: Column) -> Column:
    """Decimal text to DOUBLE; anything else becomes NULL."""
    return _bare_to_double(strip(text))


def _bare_to_double(bare: Column) -> Column:
    return F.when(bare.rlike(_NUMBER), bare.try_cast("double"))


def to_int(text: Column) -> Column:
    """Whole-number text to INT; decimal text is cut at the point."""
    return to_double(text).try_cast("int")


def clean_float_ddr(text: Column) -> Column:
    value = to_double(text)
    return F.when(value >= DDR_MISSING_BELOW, value)


def clean_float_witsml(text: Column) -> Column:
    return _unless_missing(to_double(text))


def _unless_missing(value: Column) -> Column:
    return F.when(~value.isin(*WITSML_MISSING), value)


def clean_floats_witsml(texts: Sequence[Column]) -> Column:
    """``clean_float_witsml`` of many texts, as an array.

    Every step is a pass over the array: a text is trimmed, tested and read once, and the generated code does
    not grow with the texts.  Written out, a dozen of them make a method that the JVM does not compile.
    """
    values = F.transform(F.transform(F.array(*texts), strip), _bare_to_double)
    return F.transform(values, _unless_missing)


def scaled(col: Column, factor: float) -> Column:
    return col * F.lit(factor)


def rpm_in_range(rpm: Column) -> Column:
    return F.when((rpm >= 0) & (rpm <= 300), rpm)


def truthy(col: Column) -> Column:
    """Present and not zero: the way depths, hole sizes and mud values are tested."""
    return col.isNotNull() & (col != 0)


def duration_hrs(start: Column, end: Column) -> Column:
    """Hours between two timestamp columns, 0 where either is missing; may be negative."""
    micros = F.timestamp_diff("MICROSECOND", start, end)
    return F.coalesce(micros / F.lit(3.6e9), F.lit(0.0))


_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"
_OFFSET = r"\d{2}(Z|[+-]\d{2}(:?\d{2})?)$"


def iso_duration_hrs(start: Column, end: Column) -> Column:
    """Hours between two ISO strings; 0 when one does not parse or only one has an offset."""

    def aware(text: Column) -> Column:
        return F.length(text).__gt__(10) & F.substring(text, 11, 40).rlike(_OFFSET)

    def parsed(text: Column, kind: str) -> Column:
        return F.when(text.rlike(_ISO), text.try_cast(kind))

    naive = duration_hrs(parsed(start, "timestamp_ntz"), parsed(end, "timestamp_ntz"))
    zoned = duration_hrs(parsed(start, "timestamp"), parsed(end, "timestamp"))
    return (
        F.when(aware(start) & aware(end), zoned)
        .when(~aware(start) & ~aware(end), naive)
        .otherwise(F.lit(0.0))
    )


def hole_section_name(size: Column) -> Column:
    """Name of the closest nominal size if it is nearer than 2 inches; ties go to the larger."""
    ranked = F.array(
        *[
            F.struct(
                F.abs(size - F.lit(nominal)).alias("gap"),
                F.lit(position).alias("position"),
                F.lit(name).alias("name"),
            )
            for position, (nominal, name) in enumerate(HOLE_SECTIONS)
        ]
    )
    best = F.array_min(ranked)
    return (
        F.when(size.isNull(), F.lit("Unknown"))
        .when(best["gap"] < 2.0, best["name"])
        .otherwise(F.concat(size.cast("string"), F.lit('" Section')))
    )


def interval_mid(top: Column, bottom: Column) -> Column:
    return (F.coalesce(top, F.lit(0.0)) + F.coalesce(bottom, F.lit(0.0))) / F.lit(2.0)


def fixed_mean(value: str, n: Column | None = None) -> Column:
    """Aggregate: the mean to nine digits, summed in decimals, so that the order of rows cannot show.

    ``n`` is the number of rows that a row stands for.
    """
    fixed = F.col(value).cast("decimal(18,9)")
    times = F.when(fixed.isNotNull(), F.lit(1) if n is None else n).cast("decimal(10,0)")
    return (F.sum(fixed * times) / F.sum(times)).cast("double")


def zscore(value: Column, mean: Column, sigma: Column, n: Column) -> Column:
    """Population z-score; 0 for fewer than two values or no spread."""
    return F.when((n < 2) | sigma.isNull() | (sigma == 0), F.lit(0.0)).otherwise(
        (value - mean) / F.nullif(sigma, F.lit(0.0))
    )
