"""Rejected rig files, rig streams, read-only SQL, bucketed tables and counts from footers."""

import shutil

import pytest
from pyspark.sql import functions as F

from oracle import plain
from strataflow.operators import overview
from strataflow.sources import tables, witsml
from strataflow.streaming import rig
from test_sources import _w, witsml_dir  # noqa: F401


def names(rows):
    return {(r.file.rsplit("/", 3)[-3] + "/" + r.file.rsplit("/", 1)[-1], r.error) for r in rows}


def test_rejected_rig_files(spark, witsml_dir, tmp_path):  # noqa: F811
    root = tmp_path / "rig"
    shutil.copytree(witsml_dir, root)
    (root / "Well A/2/mudLog").mkdir(parents=True)
    (root / "Well A/2/mudLog/empty.xml").write_text("")
    (root / "Well A/2/mudLog/other.xml").write_text(_w("logs", "<log>1</log>"))
    (root / "Well A/2/message/cut.xml").write_text("<messages><message><dTim>1</dTim></message><message><dTim>2")
    errors = {(r.file.rsplit("/", 1)[-1], r.error) for r in witsml.rig_file_errors(spark, str(root)).collect()}
    assert {("empty.xml", "Empty file"), ("other.xml", "No geologyInterval element"), ("a.xml", "No wellbore element")} <= errors
    named = {file for file, _ in errors}
    # Files cut off inside an element are named too; good files are not.
    assert {"bad.xml", "cut.xml"} <= named
    assert not named & {"l.xml", "r.xml", "t1.xml", "t2.xml", "m.xml", "b.xml"}


def rows_of(df):
    return sorted((tuple(plain(v) for v in r) for r in df.collect()), key=repr)


def arrive(source, target, part):
    """Copies half of the files of a folder tree; the second half has the files whose names sort first."""
    for file in sorted(source.rglob("*.xml")):
        early = file.name in ("t2.xml", "l.xml", "m.xml", "b.xml")
        if early == (part == 1):
            place = target / file.relative_to(source)
            place.parent.mkdir(parents=True, exist_ok=True)
            shutil.copy(file, place)


def test_streams_equal_the_batch(spark, witsml_dir, tmp_path):  # noqa: F811
    from pathlib import Path

    source, root, out = Path(witsml_dir), tmp_path / "arriving", str(tmp_path / "out")
    for kind in ("bhaRun", "mudLog", "trajectory", "message"):
        (root / "Well A/1" / kind).mkdir(parents=True)
    sections = witsml.read_sections(spark, witsml_dir)
    for part in (1, 2):
        arrive(source, root, part)
        for table in rig.APPENDED:
            rows = rig.stream_rig(spark, str(root), table, sections, max_files=1)
            rig.append_rig_table(rows, table, out, str(tmp_path / f"cp_{table}")).awaitTermination(120)
        stations = rig.stream_stations(spark, str(root), sections, max_files=1)
        rig.update_stations(stations, out, str(tmp_path / "cp_stations")).awaitTermination(120)
    batch = witsml.read_witsml(spark, witsml_dir)
    for table in rig.APPENDED:
        assert rows_of(spark.read.parquet(f"{out}/{table}")) == rows_of(tables.by_name(batch[table], table))
    # t1.xml came after t2.xml and took back its depth.
    assert rows_of(rig.latest_stations(spark, out)) == rows_of(tables.by_name(batch["witsml_trajectory"], "witsml_trajectory"))


@pytest.fixture
def some(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "well string, n int")
    return {"ddr_status": df, "other": df}


WRITES = [
    "insert into ddr_status values ('c', 3)",
    "insert overwrite directory '/tmp/nowhere' using parquet select * from ddr_status",
    "with x as (select * from ddr_status) insert into other select * from x",
    "from ddr_status insert into other select *",
    "drop table ddr_status",
    "drop view ddr_status",
    "set spark.sql.shuffle.partitions=3",
    "reset",
    "create table t as select * from {ddr_status}",
    "create temporary view v as select 1",
    "cache table ddr_status",
    "delete from ddr_status",
    "use default",
    "explain select 1",
    "add jar '/tmp/x.jar'",
    "begin drop view ddr_status; end",
    "select transform(well) using 'cat' as (w) from ddr_status",
    "select reflect('java.lang.System', 'exit', 1) from ddr_status",
    "select * from ddr_status where n in (select java_method('java.lang.Math', 'random') from other)",
    "with x as (select transform(well) using 'cat' as (w) from ddr_status) select * from x",
]


@pytest.mark.parametrize("text", WRITES)
def test_only_queries_run(spark, some, text):
    some["ddr_status"].createOrReplaceTempView("ddr_status")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with pytest.raises(PermissionError):
        overview.run_sql(some, text)
    assert spark.table("ddr_status").count() == 2 and spark.conf.get("spark.sql.shuffle.partitions") == before


QUERIES = [
    ("select * from {ddr_status}", 2),
    ("with x as (select well from ddr_status), y as (select * from x) select * from y where well in (select well from x)", 2),
    ("select a.well from ddr_status a join {other} b on a.n < b.n", 1),
    ("select well from ddr_status union all (select well from other order by n limit 1)", 3),
    ("values (1), (2), (3)", 3),
    ("select well, row_number() over (order by n) as r, (select max(n) from other) as m from ddr_status", 2),
    ("from ddr_status select well where exists (select 1 from other o where o.n > ddr_status.n)", 1),
]


@pytest.mark.parametrize("text, n", QUERIES)
def test_queries_of_every_shape_run(some, text, n):
    assert overview.run_sql(some, text).count() == n


def test_joins_of_bucketed_tables_need_no_exchange(spark):
    rows = spark.range(2_000).select(F.concat(F.lit("w"), F.col("id") % 7).alias("well"), (F.col("id") % 50).cast("string").alias("date"), "id")
    frames = {"left_rows": rows, "right_rows": rows.filter("id % 3 = 0")}
    tables.save_bucketed(frames, 4, "bucket_test_")
    saved = tables.BucketedTables(spark, list(frames), "bucket_test_")
    keys = ["well", "date"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        daily = saved["left_rows"].groupBy(*keys).agg(F.count("*").alias("n"))
        last = saved["right_rows"].groupBy(*keys).agg(F.max("id").alias("m"))
        for met in (daily.join(last, keys, "left"), saved["left_rows"].join(last, keys, "left_anti"), saved["left_rows"].join(saved["right_rows"].select(*keys).distinct(), keys, "left_semi")):
            assert "Exchange" not in met._jdf.queryExecution().executedPlan().toString()
        again = rows.groupBy(*keys).agg(F.count("*").alias("n")).join(rows.filter("id % 3 = 0").groupBy(*keys).agg(F.max("id").alias("m")), keys, "left")
        assert rows_of(daily.join(last, keys, "left")) == rows_of(again)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in frames:
            spark.sql(f"drop table bucket_test_{name}")
    with pytest.raises(KeyError):
        saved["unknown"]


def test_counts_come_from_footers(spark, sf_dir="/root/testdata/sf0.001"):
    counts = tables.footer_counts(spark, {n: f"{sf_dir}/{n}.parquet" for n in ("orders", "documents")})
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PushedAggregation: [COUNT(*)]") == 2
    want = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet").count() for n in ("orders", "documents")}
    assert {r.table_name: r.row_count for r in counts.collect()} == want
    # Tables read elsewhere keep the usual reader.
    assert "BatchScan" not in spark.read.parquet(f"{sf_dir}/orders.parquet")._jdf.queryExecution().executedPlan().toString()


def test_schema_with_numbers_of_values(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "id int, `a b` string")
    assert [tuple(r) for r in overview.table_schema({"t": df}, "t").collect()] == [(0, "id", "int", 2), (1, "a b", "string", 1)]
