"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a scratch folder only where the
    session names none and everything runs in one process (tests)."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="linewise-llm-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df written once to the shared folder (a folder per value of the columns
    `by`) and read back: cuts the lineage, and a lost executor costs a reread,
    not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex[:12]}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


FILTER = 1 << 26  # hashed bits of `marked`: 8 MB at every size of the input


def marked(df: DataFrame, key: str, ids: DataFrame, mark: str, exact: bool = False) -> DataFrame:
    """df with the boolean column `mark`: true wherever the id in df's column
    `key` is in ids (a single column), else nearly always false.  A bitmap of
    hashed ids is broadcast, so wide rows that a join would not need stay where
    they are; only the share of rows marked in vain grows with the number of ids.

    exact: ids are row numbers of monotonically_increasing_id, taken as they are,
    so none is marked in vain; that is one bit for each row (in steps of 4 KB for
    each partition that numbered them)."""
    at, bits = fresh(df, "__bucket", "__bits")
    place = lambda c: (F.col(c) if exact else F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(FILTER))) + 1
    held = ids.select(place(ids.columns[0]).alias("p")).groupBy(F.bitmap_bucket_number("p").alias(at)).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias(bits))
    out = df.withColumn(at, F.bitmap_bucket_number(place(key))).join(F.broadcast(held), at, "left")
    bit = F.bitmap_bit_position(place(key))
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False)).alias(mark))


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, as UTF-8 bytes."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that clash with none of df's (case-insensitive)."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        have.add(n.lower())
        out.append(n)
    return out


def drop_new(df: DataFrame, names) -> DataFrame:
    """Without the columns that an operator is about to add: its own win."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), vectorised; the same on every machine."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


class Bounded(dict):
    """A memo that is emptied when it reaches its limit: results never depend on it."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit

    def put(self, key, value):
        if len(self) >= self.limit:
            self.clear()
        self[key] = value
        return value
