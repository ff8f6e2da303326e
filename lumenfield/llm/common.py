"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as character class members for Java and Python patterns.
SPACE = r"\x20\x09-\x0D"
BITMAP_BITS = 26
WORD = rf"[^{SPACE}]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder that the driver and all executors can reach."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:  # tests on one machine; elsewhere executors would each write to a disk of their own
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/lumenfield-{uuid.uuid4().hex}"


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, keeps no state on executors, and makes later uses agree on one set of rows.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def likely_among(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``column`` is not in the one column of ``ids``; all others stay.

    Ids are bits of a bitmap, 8 MB at most whatever their number, that is broadcast: a join that follows shuffles few rows in vain."""
    place = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - BITMAP_BITS)
    slot_of = lambda c: F.shiftrightunsigned(place(c), 15).cast("int")  # noqa: E731  a bitmap of the engine's has 2**15 bits
    slot, bits = free_name(rows, "slot"), free_name(rows, "bits")
    told = ids.groupBy(slot_of(ids.columns[0]).alias(slot)).agg(F.bitmap_construct_agg(place(ids.columns[0]) % (1 << 15)).alias(bits))
    own = (place(column) % (1 << 15)).cast("int")
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(own, 3) + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.withColumn(slot, slot_of(column)).join(F.broadcast(told), slot)
    return met.where(F.getbit(byte, own % 8) == 1).select(*rows.columns)


def free_name(df: DataFrame, base: str) -> str:
    """``base``, or the first of base_1, base_2, ... that is no column of ``df`` (names clash without regard to case)."""
    taken, name, n = {c.lower() for c in df.columns}, base, 0
    while name.lower() in taken:
        n += 1
        name = f"{base}_{n}"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, however often ``body`` names it."""
    return F.transform(F.array(value), body).getItem(0)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
