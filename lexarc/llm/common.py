"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_mod(col: str, n: int):
    """crc32 of the id as decimal text, modulo n; null for a null id."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, or where it is unset a temporary one (local runs and tests)."""
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        at = sc._jsc.sc().getCheckpointDir()
        known = at.get() if at.isDefined() else None
    if not known:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = tempfile.mkdtemp(prefix="lexarc-")
        sc.setCheckpointDir(known)
    return known


#: Rows and bytes that pass to Python at once while a table is written: rows can hold long texts or blocks of bitmaps.
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20


class Scratch:
    """Intermediate tables as Parquet in the shared folder: they cut lineage and outlive executors.

    `keep` writes and rereads a frame; `drop` removes tables that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.n}"
        self.n += 1
        schema = df.schema
        conf, names = self.spark.conf, [f"spark.sql.execution.arrow.{x}" for x in ("maxRecordsPerBatch", "maxBytesPerBatch")]
        usual = [conf.get(x) for x in names]
        rows = int(usual[0])
        conf.set(names[0], str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS))
        conf.set(names[1], str(BATCH_BYTES))
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            for x, was in zip(names, usual, strict=True):
                conf.set(x, was)
        out = self.spark.read.schema(schema).parquet(path)
        out._lexarc_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._lexarc_path)
            path.getFileSystem(conf).delete(path, True)


#: A join deals a key with over one SLICES-th of all rows to slots; no more than SLICES keys can have that many.
SLICES = 20_000


def join_spread(rows: DataFrame, facts: DataFrame, keys: list[str], n: str) -> DataFrame:
    """rows joined with facts by keys, however many rows one key has.

    facts has one row a key, and in column n the number of rows with it. A key of more than one SLICES-th of all such rows
    goes to slots of that size, and its fact to each of them. These keys, at most SLICES of them, are broadcast.
    """
    total = facts.agg(F.sum(n).alias("t")).first().t
    cut = max(1, -(-int(total or 0) // SLICES))
    slots, slot = "slots_" + "_".join(keys), "slot_" + "_".join(keys)  # names that no column has
    some = facts.withColumn(slots, F.expr(f"cast(ceil({n} / {cut}) as int)"))
    many = F.broadcast(some.filter(f"{slots} > 1").select(*keys, slots))
    dealt = rows.join(many, keys, "left").withColumn(slot, F.coalesce(F.expr(f"cast(floor(rand(7) * {slots}) as int)"), F.lit(0))).drop(slots)
    each = some.withColumn(slot, F.explode(F.expr(f"sequence(0, {slots} - 1)"))).drop(slots, n)
    return dealt.join(each, [*keys, slot]).drop(slot)


def release() -> None:
    """Gives memory that a finished task no longer uses back to the machine: Python workers are kept for later tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def position(col: str, bits: int):
    """Place of a value in a bitmap of so many bits."""
    return F.pmod(F.xxhash64(col), F.lit(bits))


def bitmap(df: DataFrame, col: str, low: int = 1 << 20, high: int = 1 << 27):
    """(bits, bytes) with the places of a column's values set: a filter without false negatives.

    Its size follows the number of values up to a fixed bound; beyond it lets more pass, and callers check exactly.
    """
    import numpy as np

    values = df.select(col)
    n, bits = values.count(), low
    while bits < min(high, 8 * n):
        bits *= 2
    marks = np.zeros(bits // 8, dtype=np.uint8)
    # bitmap buckets and positions count from value 1: bucket g holds the values from (g - 1) * 32768 + 1
    parts = values.select((position(col, bits) + 1).alias("h")).groupBy(F.expr("bitmap_bucket_number(h)").alias("g")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(h))").alias("m"))
    for r in parts.toLocalIterator():
        begin = (r.g - 1) * 4096
        marks[begin:begin + 4096] = np.frombuffer(r.m, dtype=np.uint8)
    return bits, marks
