"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlens.session import scratch_path, shared_dir

#: A word is a maximal run of characters other than space and \t\n\v\f\r.
WORD = r"[^\x20\x09-\x0D]+"


class Memo(dict):
    """A dictionary that computes what it lacks. It holds about ``limit`` bytes at most
    (``each`` an entry beside its key) and starts anew when full; keys of more than 128
    characters are computed every time, so no text without white space stays in a worker.
    """

    def __init__(self, make, limit: int, each: int):
        super().__init__()
        self.make, self.limit, self.each, self.size = make, limit, each, 0

    def __missing__(self, key):
        value = self.make(key)
        long = 8 if isinstance(key, int) else len(key)
        if long <= 128:
            if self.size > self.limit:
                self.forget()
            self.size += self.each + long
            self[key] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.size = 0


#: 64-bit hash of a word, remembered within 16 MB in each Python worker.
word_hash = Memo(xxhash.xxh3_64_intdigest, 16 << 20, 180)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is written inside lets go of its shuffle files once it is written (Spark's own setting,
    put back after), so the disk holds one step's shuffles and not those of the whole job."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder, lineage cut."""
    shared_dir(df.sparkSession)
    with shuffles_freed(df.sparkSession):
        return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder (smaller than a checkpoint), gone when the session ends."""
    path = scratch_path(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def text_of(col: str = "text") -> Column:
    """The text, a null read as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id's decimal text is 2 modulo 4; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_weighted(rows: DataFrame, side: DataFrame, on: list[str], weight: str, total: int, parts: int = 2000) -> DataFrame:
    """``rows`` inner-joined with ``side``, whose keys are unique and whose ``weight``
    bounds how many rows share a key; all weights together are ``total`` at most.

    At most ``parts`` keys reach the ``parts``-th part of the total: these are
    broadcast. Every other key has few rows, so no task of the shuffled join gets a hot one.
    """
    least = total // parts + 1
    heavy = F.broadcast(side.where(F.col(weight) >= least))
    light = side.where(F.col(weight) < least)
    rest = rows.join(heavy.select(*on), on, "left_anti")
    return rows.join(heavy, on).unionByName(rest.join(light, on))


def first_rows(df: DataFrame, by: list[str], order: list[Column], n: int, parts: int = 256) -> DataFrame:
    """The first ``n`` rows of each group with their place ``_n``: first of each ``parts``-th of
    a group, dealt by hash, then of what is left, so no task sorts a whole group."""
    dealt = df.withColumn("_deal", F.pmod(F.xxhash64(*df.columns), F.lit(parts)))
    some = dealt.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "_deal").orderBy(*order))).where(F.col("_n") <= n)
    return some.drop("_deal").withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n)
