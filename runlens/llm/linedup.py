"""Incremental line dedup: sharded cuckoo filters before exact reference counts.

A ``LineIndex`` is a folder of tables that takes documents in and out again:

* ``refs``: one row per (line key, document) and batch, +1 where the document came
  in, -1 where it went;
* ``counts``: for every key that a batch touched, in how many ids (and rows) it now
  is and the largest id among them; the newest entry of a key holds;
* ``filters``: one cuckoo filter a shard, over the keys that are in some document.

A batch's keys meet their shard's filter first. What the filter has not seen is new
and needs no look-up; only what it may have seen is joined with the exact counts.
A key enters its filter with its first document and leaves with its last, which is
what a cuckoo filter can do and a Bloom filter cannot, so taking documents out
restores the state without them. When shards fill up, their number is doubled and
the filters are rebuilt from the counts. Tables are written whole before the index
names them, so a failed step leaves the state as it was; ``LineIndex`` opened again on
the folder goes on from the last finished step.

Keys are 128-bit BLAKE2b digests of the normalised line; equality of digests is
taken for equality of lines.

Defined cases: a null or empty text is one empty line. Rows that share an id count as
one document for every line; a null id is an id, the smallest, so it never keeps a
line that three ids hold. A document taken in twice is there once; one that isn't there
leaves unnoticed. Ties don't arise: the holder of a key is one id, and all lines
of it in rows of that id stay. Other columns are kept as they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm.common import join_weighted, shuffles_freed
from runlens.session import path_exists, scratch_path

_SPACE = b" \t\n\x0b\x0c\r"
_UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Buckets of a shard's filter, four 16-bit slots each (256 KB).
BUCKETS = 1 << 15
#: Keys per shard at which the shards are doubled (61 % of its slots).
FULL = 80_000
#: Moves before an insertion gives up and the shards are doubled.
KICKS = 500


def line_key(line: bytes, least: int) -> bytes | None:
    """Digest of a line without outer white space, A-Z lower-cased; None if shorter than ``least`` code points."""
    key = line.strip(_SPACE).translate(_UPPER)
    if len(key) < least or len(key) < 4 * least and len(key.decode()) < least:
        return None
    return blake2b(key, digest_size=16).digest()


class CuckooFilter:
    """Fingerprints of digests in a table of four-slot buckets."""

    def __init__(self, slots: bytes | None = None):
        self.slots = np.frombuffer(slots, np.uint16).tolist() if slots else [0] * (4 * BUCKETS)

    def to_bytes(self) -> bytes:
        return np.array(self.slots, np.uint16).tobytes()

    @staticmethod
    def places(key: bytes) -> tuple[int, int, int]:
        """(fingerprint, first slot of either bucket). The digest's first four bytes name the shard."""
        mark = int.from_bytes(key[4:6], "little") or 1
        first = int.from_bytes(key[6:10], "little") % BUCKETS
        return mark, 4 * first, 4 * CuckooFilter.other(first, mark)

    @staticmethod
    def other(bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995 >> 7)) % BUCKETS

    def __contains__(self, key: bytes) -> bool:
        mark, a, b = self.places(key)
        s = self.slots
        return mark in s[a:a + 4] or mark in s[b:b + 4]

    def add(self, key: bytes) -> bool:
        """Whether the key found a place; if not, the filter must be rebuilt with more shards."""
        mark, a, b = self.places(key)
        s = self.slots
        for at in (*range(a, a + 4), *range(b, b + 4)):
            if not s[at]:
                s[at] = mark
                return True
        at = b
        for i in range(KICKS):
            victim = at + (mark + i) % 4
            mark, s[victim] = s[victim], mark
            at = 4 * self.other(at // 4, mark)
            for free in range(at, at + 4):
                if not s[free]:
                    s[free] = mark
                    return True
        return False

    def remove(self, key: bytes) -> None:
        mark, a, b = self.places(key)
        for at in (*range(a, a + 4), *range(b, b + 4)):
            if self.slots[at] == mark:
                self.slots[at] = 0
                return


def _part(text: str = "text") -> Column:
    """Tells apart rows of one id: a third of all rows may have the same or none."""
    return F.xxhash64(text)


def references(docs: DataFrame, least: int) -> DataFrame:
    """(key, doc_id, part): the distinct line keys of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, keys = [], []
            for i, text in enumerate(b.column(2).cast(pa.binary()).to_pylist()):
                found = {k for k in (line_key(x, least) for x in text.split(b"\n")) if k}
                row += [i] * len(found)
                keys += found
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), b.column(0).take(at), b.column(1).take(at)],
                                             ["key", "doc_id", "part"])

    return docs.select("doc_id", _part().alias("part"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        run, "key binary, doc_id long, part long")


def shard_of(key: Column, shards: int) -> Column:
    return F.conv(F.hex(F.substring(key, 1, 4)), 16, 10).cast("long").bitwiseAND(F.lit(shards - 1)).cast("int")


def _held(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(key, n, holder, rows) of references: ids other than the ``known`` (key, doc_id), the
    largest id, all rows. Two levels of partial sums, so no key is hot."""
    ids = rows.groupBy("key", "doc_id").agg(F.count("*").alias("rows"))
    new = F.lit(1)
    if known is not None:
        had = known.select(F.col("key").alias("_key"), F.col("doc_id").alias("_id")).distinct()
        ids = ids.join(had, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
        new = F.col("_key").isNull().cast("int")
    return ids.groupBy("key").agg(F.sum(new).alias("n"), F.max("doc_id").alias("holder"), F.sum("rows").alias("rows"))


def _live(refs: DataFrame) -> DataFrame:
    """(key, doc_id, part) whose comings outweigh their goings."""
    return refs.groupBy("key", "doc_id", "part").agg(F.sum("sign").alias("sign")).where("sign > 0").drop("sign")


def _without(rows: DataFrame, others: DataFrame) -> DataFrame:
    """The references that are not among the others."""
    o = others.select(*(F.col(c).alias(f"_{c}") for c in ("key", "doc_id", "part")))
    same = (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("part") == F.col("_part"))
    return rows.join(o, same, "left_anti")


class LineIndex:
    """Documents' lines with their reference counts, in a folder that all executors reach.

    ``path``: an existing index's folder, or where to start one (default: a scratch
    folder, gone when the session ends). ``least``: code points from which a line counts.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, least: int = 20):
        self.spark, self.path, self.least = spark, path or scratch_path(spark, "lines"), least
        self.step, self.shards, self.ids, self.refs, self.counts, self.filters, self.keys = 0, 8, [], [], [], None, 0
        self.gone = False
        if path and path_exists(spark, f"{path}/state"):
            last = spark.read.parquet(f"{path}/state").orderBy(F.desc("step")).first()
            self.step, self.shards, self.filters, self.keys, self.gone = last.step, last.shards, last.filters, last["keys"], last.gone
            self.ids, self.refs, self.counts, self.least = last.ids, last.refs, last.counts, last.least

    def _write(self, df: DataFrame, name: str) -> str:
        path = f"{self.path}/{name}-{self.step + 1}-{uuid.uuid4().hex[:8]}"
        with shuffles_freed(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        return path

    def _finish(self) -> None:
        """One row names the tables of the new state."""
        self.step += 1
        row = (self.step, self.shards, self.filters, self.keys, self.gone, self.ids, self.refs, self.counts, self.least)
        self.spark.createDataFrame([row], "step int, shards int, filters string, keys long, gone boolean, ids array<string>, refs array<string>, "
                                          "counts array<string>, least int").coalesce(1).write.mode("append").parquet(f"{self.path}/state")

    def references(self) -> DataFrame:
        """(key, doc_id, part) of the documents that are in."""
        rows = self.spark.read.parquet(*self.refs)
        return _live(rows) if self.gone else rows.select("key", "doc_id", "part")

    def current(self, keys: DataFrame | None = None) -> DataFrame:
        """(key, n, holder, rows) of all ``keys`` in some document: the newest entry of each."""
        rows = self.spark.read.parquet(*self.counts)
        rows = rows if keys is None else rows.join(keys, "key", "left_semi")
        newest = rows.groupBy("key").agg(F.max(F.struct("step", "n", "holder", "rows")).alias("c"))
        return newest.select("key", "c.n", "c.holder", "c.rows").where("n > 0")

    def _probed(self, keys: DataFrame) -> DataFrame:
        """``keys`` with ``seen``: whether their shard's filter may hold them."""
        if self.filters is None:
            return keys.withColumn("seen", F.lit(False))
        schema = "key binary, n long, holder long, rows long, seen boolean"

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            f = CuckooFilter(right["slots"][0].as_py() if right.num_rows else None)
            keys = left["key"].to_pylist()
            return left.select(["key", "n", "holder", "rows"]).append_column("seen", pa.array([k in f for k in keys], pa.bool_()))

        shards = self.spark.read.parquet(self.filters)
        return (keys.select("key", "n", "holder", "rows", shard_of(F.col("key"), self.shards).alias("shard")).groupBy("shard")
                .cogroup(shards.groupBy("shard")).applyInArrow(run, schema))

    def _refiltered(self, changes: DataFrame, old: str | None) -> str | None:
        """The filters after ``changes`` (key, add); None if a shard has no room."""
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            f, good = CuckooFilter(right["slots"][0].as_py() if right.num_rows else None), True
            for key, add in zip(left["key"].to_pylist(), left["add"].to_pylist()):
                if not add:
                    f.remove(key)
                elif not f.add(key):
                    good = False
                    break
            shard = (left if left.num_rows else right)["shard"][0].as_py()
            return pa.table({"shard": pa.array([shard], pa.int32()), "slots": pa.array([f.to_bytes()], pa.binary()), "good": [good]})

        empty = self.spark.createDataFrame([], "shard int, slots binary, good boolean")
        shards = self.spark.read.parquet(old) if old else empty
        rows = changes.select("key", "add", shard_of(F.col("key"), self.shards).alias("shard")).groupBy("shard")
        path = self._write(rows.cogroup(shards.groupBy("shard")).applyInArrow(run, "shard int, slots binary, good boolean"), "filters")
        return path if self.spark.read.parquet(path).where("NOT good").isEmpty() else None

    def _refill(self, changes: DataFrame, growth: int) -> None:
        """Brings the filters up to date, with more shards if they are full."""
        self.keys += growth
        if self.keys <= FULL * self.shards:
            path = self._refiltered(changes, self.filters)
            if path:
                self.filters = path
                return
        while True:
            while self.keys > FULL // 2 * self.shards:
                self.shards *= 2
            self.filters = self._refiltered(self.current().select("key", F.lit(True).alias("add")), None)
            if self.filters:
                return
            self.shards *= 2

    def insert(self, docs: DataFrame) -> None:
        """Takes documents in."""
        ids = self._write(docs.select("doc_id").distinct(), "ids")
        refs = self._write(references(docs, self.least).distinct().withColumn("sign", F.lit(1)), "refs")
        rows, known = self.spark.read.parquet(refs), None
        if self.ids:
            old = self.spark.read.parquet(*self.ids).withColumnRenamed("doc_id", "_id")
            again = self.spark.read.parquet(ids).join(old, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").withColumnRenamed("doc_id", "_again")
            if not again.isEmpty():  # what these ids hold already isn't taken in twice
                known = self.references().join(again, F.col("doc_id").eqNullSafe(F.col("_again")), "left_semi")
                refs = self._write(_without(rows, known), "refs")
                rows = self.spark.read.parquet(refs)
        found = self.spark.read.parquet(self._write(self._probed(_held(rows, known)), "probed"))
        fresh, seen = found.where("NOT seen").drop("seen"), found.where("seen").drop("seen")
        counts = fresh.withColumn("known", F.lit(False))
        if self.counts:  # the filter's maybe: the exact counts tell
            was = self.current(seen.select("key")).select("key", *(F.col(c).alias(f"_{c}") for c in ("n", "holder", "rows")))
            counts = counts.unionByName(seen.join(was, "key", "left").select(
                "key", (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"), F.greatest("holder", "_holder").alias("holder"),
                (F.col("rows") + F.coalesce("_rows", F.lit(0))).alias("rows"), F.col("_n").isNotNull().alias("known")))
        written = self._write(counts.withColumn("step", F.lit(self.step + 1)), "counts")
        self.ids, self.refs, self.counts = [*self.ids, ids], [*self.refs, refs], [*self.counts, written]
        added = self.spark.read.parquet(written).where("NOT known").select("key", F.lit(True).alias("add"))
        self._refill(added, added.count())
        self._finish()

    def delete(self, docs: DataFrame) -> None:
        """Takes the documents with the ids of ``docs`` out; every line decision is then as if they had never come."""
        if not self.refs:
            return
        ids = docs.select("doc_id").distinct().withColumnRenamed("doc_id", "_gone")
        live = self.references()
        going = live.join(ids, F.col("doc_id").eqNullSafe(F.col("_gone")), "left_semi")
        path = self._write(going.withColumn("sign", F.lit(-1)), "refs")
        out = self.spark.read.parquet(path).drop("sign")
        keys = out.select("key").distinct()
        left = _held(_without(live.join(keys, "key", "left_semi"), out))
        counts = keys.join(left, "key", "left").select(
            "key", F.coalesce("n", F.lit(0)).alias("n"), "holder", F.coalesce("rows", F.lit(0)).alias("rows"),
            F.lit(True).alias("known"), F.lit(self.step + 1).alias("step"))
        written = self._write(counts, "counts")
        self.refs, self.counts, self.gone = [*self.refs, path], [*self.counts, written], True
        removed = self.spark.read.parquet(written).where("n = 0").select("key", F.lit(False).alias("add"))
        self._refill(removed, -removed.count())
        self._finish()

    def dropped(self, copies: int) -> DataFrame:
        """(key, doc_id, part): the lines that documents lose, as ``copies`` ids or more hold them and theirs isn't the largest."""
        hot = self.spark.read.parquet(self._write(self.current().where(F.col("n") >= copies), "hot"))
        rows = self.references()
        lost = join_weighted(rows, hot, ["key"], "rows", hot.agg(F.sum("rows")).first()[0] or 0)
        return lost.where(~F.col("doc_id").eqNullSafe(F.col("holder"))).select("key", "doc_id", "part")


def without_repeats(docs: DataFrame, index: LineIndex, copies: int = 3) -> DataFrame:
    """``docs`` with ``text`` reduced to the lines that stay, ``n_lines`` before and ``n_dropped``.

    A line is dropped if its key is in ``copies`` documents of the index or more, save in
    the one with the largest id. Rows that the index doesn't hold keep all lines.
    """
    least = index.least
    lost = index.dropped(copies).groupBy("doc_id", "part").agg(F.collect_set("key").alias("_lost"))
    rows = docs.withColumn("_part", _part())
    rows = rows.join(lost.withColumnsRenamed({"doc_id": "_id", "part": "_p"}),
                     F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_part") == F.col("_p")), "left").drop("_id", "_p", "_part")
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, gone in zip(b.column(at).cast(pa.binary()).to_pylist(), b.column(len(names)).to_pylist()):
                lines = (text or b"").split(b"\n")
                gone = set(gone or ())
                kept = [x for x in lines if line_key(x, least) not in gone] if gone else lines
                texts.append(b"\n".join(kept))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            columns = b.columns[:len(names)]
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                                             [*names, "n_lines", "n_dropped"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "n_lines long, n_dropped long"])
    return rows.mapInArrow(run, schema)
