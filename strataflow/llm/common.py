"""Helpers shared by the text operators."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 1_000
# Fixed value: a word is a run of anything but ASCII white space.  ``bytes.split()`` cuts the same way.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> None:
    """Use the folder in ``spark.checkpoint.dir``; only a local session without one gets its own."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="strataflow-llm-")
    context.setCheckpointDir(folder)


def kept(df: DataFrame) -> DataFrame:
    """Compute once into a table in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    shared_folder(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts: sizes buckets, decides nothing about results."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]


def buckets_for(total: int, per_bucket: int, least: int = 1) -> int:
    return max(least, -(-int(total) // per_bucket))


def hash_sample(rows: DataFrame, n: int, by: list[str] | None = None) -> list:
    """At most ``n`` doc_ids (per value of ``by``), spread over the table by hash; the same in every run.

    One id per hash bucket is found by a two-step minimum, so only ids and no texts are moved.
    """
    hashed = F.xxhash64("doc_id")
    chosen = rows.groupBy(*(by or []), F.pmod(hashed, F.lit(n)).alias("bucket")).agg(
        F.min_by("doc_id", F.struct(hashed, "doc_id")).alias("doc_id")
    )
    return sorted({row["doc_id"] for row in chosen.select("doc_id").collect()})


def same_key(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality of key columns, still a hash join."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & a[key].eqNullSafe(b[key])
    return condition


def mix64(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values; wraps on purpose."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the links a-b."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            return label
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further


def single_threaded() -> None:
    """One thread per task: Spark owns the cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("RAYON_NUM_THREADS", "1")


def give_back() -> None:
    """Return freed memory to the system; the allocators would keep most of it."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim is not None:
        trim(0)


def giving_back(run: Callable) -> Callable:
    """``run`` over a task's batches, whose memory goes back to the system when they end.

    Python workers outlive their tasks, and what a task has freed would count beside all that come after it.
    """

    def work(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return work


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, which may run where it is not installed.

    Texts may be long, so rows go to the workers in batches of BATCH_ROWS.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    context = spark.sparkContext
    if getattr(context, "_strataflow_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="strataflow-code-")) / "strataflow_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, str(source.relative_to(package.parent)))
    context.addPyFile(str(archive))
    context._strataflow_shipped = True
