"""Per-well overview: ranges, hole sections, activity mix, metadata, table listings."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import of_well
from ..functions.numbers import truthy
from .ordered import union_all


def well_summary(status: DataFrame) -> DataFrame:
    return status.groupBy("well").agg(
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.countDistinct("date").alias("num_reports"),
        F.min("md_m").alias("min_md"),
        F.max("md_m").alias("max_md"),
        F.min("tvd_m").alias("min_tvd"),
        F.max("tvd_m").alias("max_tvd"),
    )


def drilled_range(status: DataFrame) -> DataFrame:
    """Dates and depth range, zero depths ignored."""
    depth = F.when(truthy(F.col("md_m")), F.col("md_m"))
    return status.groupBy("well").agg(
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.min(depth).alias("min_md"),
        F.max(depth).alias("max_md"),
    )


def hole_sections(status: DataFrame) -> DataFrame:
    return (
        status.filter(F.col("hole_diameter_in").isNotNull())
        .groupBy("well", "hole_diameter_in")
        .agg(
            F.min("date").alias("from_date"),
            F.max("date").alias("to_date"),
            F.min("md_m").alias("min_md"),
            F.max("md_m").alias("max_md"),
            F.countDistinct("date").alias("days"),
        )
    )


def share_of_well(counts: DataFrame, count: str, out: str) -> DataFrame:
    """Percent of the per-well total.  ``counts`` is aggregated: one row per well and label."""
    total = F.sum(count).over(Window.partitionBy("well"))
    return counts.withColumn(out, F.col(count) / total * 100.0)


def activity_distribution(activities: DataFrame) -> DataFrame:
    counts = (
        activities.filter(F.col("activity_code") != "")
        .groupBy("well", "activity_code")
        .agg(F.count("*").alias("cnt"), F.count_if(F.col("state") == "problem").alias("problems"))
    )
    return share_of_well(counts, "cnt", "pct")


def wellbore_meta(info: DataFrame, tie: str | None = "report_no") -> DataFrame:
    """The latest metadata row of each well."""
    fields = [c for c in info.columns if c not in ("well", "date", tie)]
    order = F.struct("date", *([tie] if tie in info.columns else []), *fields)
    return (
        info.groupBy("well").agg(F.max_by(F.struct("date", *fields), order).alias("m")).select("well", "m.*")
    )


def available_wells(status: DataFrame) -> DataFrame:
    return status.select("well").distinct()


def table_schema(tables: Mapping[str, DataFrame], name: str) -> DataFrame:
    """Column names and types of one table, in order, with the number of values of each column."""
    df = tables[name]
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    listed = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"), F.lit(k).alias("data_type"), F.col(f"c{i}").alias("n_values"))
            for i, (c, k) in enumerate(df.dtypes)
        ]
    )
    return counts.select(F.inline(listed))


def table_counts(tables: Mapping[str, DataFrame], names: list[str]) -> DataFrame:
    return union_all(
        [
            tables[n].agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
            for n in names
        ]
    )


def formation_column(tops: DataFrame, wells: list[str] | None = None) -> DataFrame:
    rows = tops if not wells else tops.filter(F.col("well").isin(*wells))
    return rows.orderBy(F.asc_nulls_last("well"), F.asc_nulls_last("md_m"))


def well_overview(tables: Mapping[str, DataFrame], well: str | None = None) -> dict[str, DataFrame]:
    """All parts of the overview, each a DataFrame over the wells that match ``well``, all for None."""
    tables = of_well(tables, well)
    return {
        "summary": well_summary(tables["ddr_status"]),
        "hole_sections": hole_sections(tables["ddr_status"]),
        "wellbore": wellbore_meta(tables["wellbore_info"]),
        "activities": activity_distribution(tables["ddr_activities"]),
        "formations": formation_column(tables["formation_tops"]),
    }


OWN_LIMIT = re.compile(r"(?is)\blimit\s+(all|\d+)(\s+offset\s+\d+)?\s*$")
# Parsed nodes that change something or run a program though they are no commands to Spark.
WRITING_NODES = {"InsertIntoDir", "ScriptTransformation"}
# Functions that call any Java method.
CALLING_FUNCTIONS = {"reflect", "java_method", "try_reflect"}


def refuse_writes(spark: SparkSession, query: str) -> None:
    """Raise ``PermissionError`` if the text is anything but a query; it is parsed, not run.

    Every node of the parsed plan is looked at: those in CTEs and in subqueries of expressions as well.
    """
    jvm = spark.sparkContext._jvm

    def loaded(name: str):
        return jvm.java.lang.Thread.currentThread().getContextClassLoader().loadClass(f"org.apache.spark.sql.catalyst.{name}")

    refused = [loaded("plans.logical.Command"), loaded("plans.logical.ParsedStatement")]
    plan_kind, subquery = loaded("plans.logical.LogicalPlan"), loaded("expressions.PlanExpression")
    function = loaded("analysis.UnresolvedFunction")

    def all_of(sequence):
        return [sequence.apply(i) for i in range(sequence.size())]

    waiting = [spark._jsparkSession.sessionState().sqlParser().parsePlan(query)]
    while waiting:
        node = waiting.pop()
        name = node.getClass().getSimpleName()
        if name in WRITING_NODES or any(kind.isInstance(node) for kind in refused):
            raise PermissionError(f"only queries are allowed, not {name}")
        if function.isInstance(node) and str(node.nameParts().last()).lower() in CALLING_FUNCTIONS:
            raise PermissionError(f"function {node.nameParts().last()} is not allowed")
        if plan_kind.isInstance(node):
            waiting += all_of(node.expressions())
            inner = all_of(node.innerChildren())
            waiting += [child for child in inner if plan_kind.isInstance(child)]
            if name == "UnresolvedWith":
                waiting += [relation._2() for relation in all_of(node.cteRelations())]
        elif subquery.isInstance(node):
            waiting.append(node.plan())
        waiting += all_of(node.children())


def run_sql(tables: Mapping[str, DataFrame], text: str, cap: int | None = None) -> DataFrame:
    """Ad-hoc query over the tables, which may be named plainly or in braces.

    Only queries run: commands, inserts and scripts are refused before anything is executed.  ``cap``
    limits a SELECT that has no LIMIT of its own; anything else, and everything without ``cap``, is
    returned whole.
    """
    query = text.strip().rstrip(";").strip()
    if not query:
        raise ValueError("empty query")
    frames = {name: tables[name] for name in tables if "{" + name + "}" in query}
    plain = [name for name in tables if re.search(rf"(?<![{{\w]){name}(?![}}\w])", query)]
    spark = tables[next(iter([*frames, *plain, *tables]))].sparkSession
    refuse_writes(spark, re.sub(r"\{(\w+)\}", r"\1", query))
    for name in plain:
        tables[name].createOrReplaceTempView(name)
    out = spark.sql(query, **frames)
    capped = cap is not None and query.lower().startswith("select") and not OWN_LIMIT.search(query)
    return out.limit(cap) if capped else out
