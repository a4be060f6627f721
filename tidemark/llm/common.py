"""Shared plumbing of the corpus operators: the shared folder, written tables, hold-out split.

Everything that must outlive one job goes to the folder the cluster names in
``spark.checkpoint.dir``; only where that is unset (tests, notebooks) a local one is set.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HELD_OUT_MOD, HELD_OUT_REST = 4, 2
MARK_BITS = 24
TEXT_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver see, as a URI or path without a trailing slash."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors and the driver share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; no two calls give the same one."""
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


@contextmanager
def _batches(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Jobs run inside hand Python at most ``rows`` rows at once, or what the session says; the setting is put back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = int(spark.conf.get(key))
    if rows is None or 0 < old <= rows:
        yield
        return
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, str(old))


def written(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """``df`` as a table written in the shared folder: cuts lineage and survives lost executors.

    ``batch``: rows that Python gets at once at most; TEXT_ROWS where whole texts are handed over, as
    workers and executors each hold a batch or two.
    """
    path = scratch(df.sparkSession, name)
    with _batches(df.sparkSession, batch):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables that are removed together once nothing reads them any more."""

    def __init__(self, spark: SparkSession) -> None:
        self._spark, self._paths = spark, []  # (name, path)

    def written(self, df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
        path = scratch(self._spark, name)
        self._paths.append((name, path))
        with _batches(self._spark, batch):
            df.write.option("compression", "zstd").parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def remove(self, *names: str) -> None:
        """Remove the tables of these names, or all of them.

        Shuffle files of ended jobs stay on the executors until the driver's collector meets their
        handles, which an idle heap can put off for long; so it is asked to look now.
        """
        jvm, conf = self._spark._jvm, self._spark._jsc.hadoopConfiguration()
        for name, p in self._paths:
            if not names or name in names:
                at = jvm.org.apache.hadoop.fs.Path(p)
                at.getFileSystem(conf).delete(at, True)
        self._paths = [x for x in self._paths if names and x[0] not in names]
        jvm.java.lang.System.gc()


def release() -> None:
    """Give this Python worker's free memory back to the system, after each batch; else the allocators keep it while other stages run."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_mark(df: DataFrame, column: str, ids: DataFrame, mark: str = "__in") -> DataFrame:
    """``df`` with a boolean column ``mark``: false only where ``column`` is not among ``ids`` (one column of whole numbers).

    True may be wrong, so an exact join follows; what is false need not be moved for it. The ids are
    sent as 2**MARK_BITS bits in words of 64, whatever their number.
    """
    slot = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(1 << MARK_BITS))
    bit = slot(ids.columns[0]).alias("slot")
    words = ids.select(bit).groupBy(F.shiftright("slot", 6).alias("__word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("__bits"))
    found = df.withColumn("__slot", slot(column)).withColumn("__word", F.shiftright("__slot", 6)).join(F.broadcast(words), "__word", "left")
    hit = F.coalesce(F.expr("shiftright(__bits, cast(__slot & 63 as int)) & 1L") == 1, F.lit(False))
    return found.withColumn(mark, hit).select(*[F.col(f"`{c}`") for c in df.columns], mark)


def among(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``column`` is among ``ids``, and a few others, without moving any row."""
    return with_mark(df, column, ids).where("__in").drop("__in")


def held_out(doc_id: Column) -> Column:
    """True for the rows no label may be learned from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_MOD == HELD_OUT_REST, F.lit(False))


def label_sample(documents: DataFrame, labels: DataFrame, label: str, rows: int, longest: int) -> list[tuple[str, int]]:
    """(text, label) of at most ``rows`` labelled documents that are not held out.

    Half the rows at most come from each class, chosen by a hash of doc_id, so the choice does not
    depend on partitioning. Texts longer than ``longest`` characters are not used to learn from
    (they are still scored whole). The result is bounded by rows * longest whatever the input.
    Rows whose id, text or label is null are passed over; of repeated ids each row counts.
    """
    lab = labels.where(~held_out(F.col("doc_id"))).select(
        "doc_id", F.col(label).cast("int").alias("y"), F.xxhash64("doc_id").alias("ord")
    ).where("y is not null and doc_id is not null")
    ids = None
    for y in (0, 1):  # 3 of 2 ids, as some documents are too long or missing
        part = lab.where(F.col("y") == y).orderBy("ord", "doc_id").limit(rows * 3 // 4)
        ids = part if ids is None else ids.unionByName(part)
    ids = ids.dropDuplicates(["doc_id"])
    got = (
        documents.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= longest))
        .join(F.broadcast(ids), "doc_id")  # at most 1.5 * rows ids
        .orderBy("ord", "doc_id", "text").limit(rows).select("text", "y")
    )
    return [(r.text, int(r.y)) for r in got.collect()]
