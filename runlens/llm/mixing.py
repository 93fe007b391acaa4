"""Mixing sources to target weights by fixed-length token blocks.

A source's words, its documents laid end to end, are packed into blocks of
``BLOCK`` words. Each output shard draws its number of blocks of every source
from a multinomial distribution (given a source's total, its counts over the
shards are multinomial with equal shares). The draws number the source's slots;
slot ``j`` is mapped to block ``permutation(j mod blocks)``, a keyed pseudorandom
permutation of the source's block indices, so a block is taken again only when
all its source's blocks have been. Slots and documents' pieces of blocks meet in
a join on (source, block), which spreads a hot source over all its blocks.

Targets: 1-based by code point, null last, sources weigh ``WEIGHTS`` in turn and
share ``SHARE`` of all words; no target is above ``CAP`` times its source's
words, the excess being reshared by weight until none is. A source takes as many
blocks as come nearest its target at its mean block length, at most CAP times
each. Offsets come from running sums over hash buckets of a source, so no task
sees a whole source. All draws are seeded by the source's number: reruns agree.

Defined cases: null or empty texts have size 0 and are never taken; a null source
is a source of its own; repeated rows (and null ids) are documents of their own;
extra columns are not read by ``plan`` and kept by ``mixed``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import WORD, cut, shuffle_parts
from runlens.operators.order import with_position

#: Words of a block, slots of an output shard, documents of a packing bucket.
BLOCK, SHARD_SLOTS, BUCKET_ROWS = 64, 16_384, 10_000
#: Source weights in turn, share of all words, most times a source or document is taken.
WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
SEED = 20_240_229
#: Texts of the mix that are made before their rows are sent on.
ROWS = 512

_WORDS = re.compile(WORD)


def targets(sizes: DataFrame) -> DataFrame:
    """sid, source, source_size, docs, target of each source; ``sizes``: a row per document."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    ranked = with_position(per, [F.col("source").isNull(), F.col("source")], "sid")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("sid") - 1) % len(WEIGHTS) + 1).cast("int"))
    state = cut(ranked.withColumn("weight", weight.cast("double")))
    cap = CAP * F.col("source_size")
    capped = F.lit(False)
    # each round caps the sources above their cap and reshares the rest; one aggregate a round
    while True:
        r = state.agg(F.sum("source_size"), F.sum(F.when(capped, cap).otherwise(0)),
                      F.sum(F.when(~capped, F.col("weight")))).first()
        level = (SHARE * (r[0] or 0) - (r[1] or 0)) / r[2] if r[2] else 0.0
        over = ~capped & (F.col("weight") * level > cap)
        if not state.where(over).limit(1).count():
            return state.withColumn("target", F.when(capped, cap.cast("double")).otherwise(F.col("weight") * level))
        capped = capped | over


def offsets(sizes: DataFrame, sources: DataFrame, buckets: int) -> DataFrame:
    """``sizes`` with ``offset``: words of the source before the document, in hash order."""
    keyed = sizes.join(sources, sizes["source"].eqNullSafe(sources["_source"])).drop("_source")
    keyed = keyed.withColumn("_bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    before = F.sum("size").over(Window.partitionBy("sid", "_bucket").orderBy("doc_id", "hash")
                                .rowsBetween(Window.unboundedPreceding, -1))
    per = keyed.groupBy("sid", "_bucket").agg(F.sum("size").alias("_n"))
    start = F.sum("_n").over(Window.partitionBy("sid").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = per.select("sid", "_bucket", F.coalesce(start, F.lit(0)).alias("_start"))
    return (keyed.withColumn("_before", F.coalesce(before, F.lit(0))).join(starts, ["sid", "_bucket"])
            .withColumn("offset", F.col("_start") + F.col("_before")).drop("_bucket", "_before", "_start"))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at ``index``: Feistel rounds, walked until below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = np.random.default_rng([SEED, key]).integers(1, 2**63, 4).astype(np.uint64)

    def scramble(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & low
        for k in keys:
            h = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ h >> np.uint64(31)) * np.uint64(0xC2B2AE3D27D4EB4F)
            left, right = right, left ^ h >> np.uint64(64 - half)
        return left << np.uint64(half) | right

    out = scramble(index.astype(np.uint64))
    while (far := out >= n).any():
        out[far] = scramble(out[far])
    return out.astype(np.int64)


def draws(sources: DataFrame) -> DataFrame:
    """sid, blocks, shard, start, count: the multinomial counts of each shard, as ranges of slots."""
    fields = sources.agg(F.sum("slots").alias("n")).first()
    shards = max(1, -(-int(fields.n or 0) // SHARD_SLOTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for sid, blocks, slots in zip(*(c.to_pylist() for c in b.columns), strict=True):
                count = np.random.default_rng([SEED, sid, shards]).multinomial(slots, np.full(shards, 1 / shards))
                start = np.cumsum(count) - count
                for i in range(0, shards, 10_000):
                    n = len(count[i : i + 10_000])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, sid)), pa.array(np.full(n, blocks)), pa.array(np.arange(i, i + n)),
                         pa.array(start[i : i + n]), pa.array(count[i : i + n])], ["sid", "blocks", "shard", "start", "count"])

    return (sources.where("slots > 0").select("sid", "blocks", "slots")
            .mapInArrow(run, "sid long, blocks long, shard long, start long, count long").where("count > 0"))


def taken_blocks(sources: DataFrame) -> DataFrame:
    """sid, block, times: how often the mix takes each block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for sid, blocks, _, start, count in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at = permuted(np.arange(start, start + count) % blocks, blocks, sid)
                block, n = np.unique(at, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(block), sid)), pa.array(block), pa.array(n)], ["sid", "block", "times"])

    # rows that name up to SHARD_SLOTS slots each are too small for AQE to see their work: a fixed number of tasks
    drawn = draws(sources).repartition(shuffle_parts(sources.sparkSession), "sid", "shard")
    slots = drawn.mapInArrow(run, "sid long, block long, times long")
    return slots.groupBy("sid", "block").agg(F.sum("times").alias("times"))


def _keyed(docs: DataFrame) -> DataFrame:
    """``key`` and ``hash``: the id and a hash of id, source and text, nulls told apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    hashed = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("source").isNull(), "source", text)
    return docs.withColumns({"key": F.coalesce("doc_id", F.lit(-1)), "hash": hashed})


def _sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, key, hash and size in words of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return _keyed(docs.select("doc_id", "source", "text")).withColumn(
        "size", F.regexp_count(text, F.lit(WORD)).cast("long")).drop("text")


def _pieces(sized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with offset and their source's figures, pieces: sid, offset, block, words, times)."""
    sources = targets(sized)
    total = sources.agg(F.sum("docs")).first()[0] or 0
    blocks = F.ceil(F.col("source_size") / BLOCK).cast("long")
    slots = F.least(CAP * F.col("blocks"), F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"))
    sources = (sources.withColumn("blocks", blocks)
               .withColumn("slots", F.when(F.col("blocks") > 0, slots).otherwise(0))
               .withColumnRenamed("source", "_source"))
    placed = cut(offsets(sized, sources.select("sid", "_source", "source_size", "target"), max(256, total // BUCKET_ROWS)))
    first, last = F.col("offset"), F.col("offset") + F.col("size") - 1
    blocks = F.sequence(F.floor(first / BLOCK), F.floor(last / BLOCK))
    pieces = (placed.where("size > 0").select("sid", "offset", "size", F.explode(blocks).alias("block"))
              .withColumn("words", F.least(F.col("offset") + F.col("size"), (F.col("block") + 1) * BLOCK)
                          - F.greatest(F.col("offset"), F.col("block") * BLOCK)))
    return placed, pieces.drop("size").join(taken_blocks(sources), ["sid", "block"])


def plan(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of each row of ``docs`` (doc_id, text, source)."""
    placed, pieces = _pieces(_sizes(docs))
    taken = pieces.groupBy("sid", "offset").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    # documents without words share an offset with the next one: they match none
    some = placed.where("size > 0").join(taken, ["sid", "offset"], "left")
    rows = some.unionByName(placed.where("size = 0"), allowMissingColumns=True)
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix as documents, with the columns of ``docs``.

    A document's text is its taken words in order (those taken again follow);
    one that is taken whole and once keeps its text; one not taken goes.
    """
    columns = docs.columns
    placed, pieces = _pieces(_sizes(docs))
    parts = pieces.groupBy("sid", "offset").agg(
        F.sort_array(F.collect_list(F.struct("block", "words", "times"))).alias("parts"))  # a document's blocks
    keys = ["key", "hash"]
    # rows equal in id, source and text are numbered, so that each gets one place
    equal = Window.partitionBy(*keys)
    chosen = (placed.where("size > 0").join(parts, ["sid", "offset"])
              .select(*keys, "size", "offset", "parts", F.row_number().over(equal.orderBy("offset")).alias("_nth")))
    repeated = placed.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    rows = _keyed(docs.select("doc_id", "source", "text", F.struct(*columns).alias("_row"))).select(*keys, "_row")
    single = rows.join(repeated, keys, "left_anti").withColumn("_nth", F.lit(1))
    several = rows.join(repeated, keys, "left_semi").withColumn("_nth", F.row_number().over(equal.orderBy(F.xxhash64("_row"))))
    pairs = single.unionByName(several).join(chosen, [*keys, "_nth"])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(at, ROWS) for at in range(0, whole.num_rows, ROWS)):
                out = []
                texts = b.column(0).field("text").to_pylist()
                for text, offset, size, got in zip(texts, *(c.to_pylist() for c in b.columns[1:]), strict=True):
                    if sum(p["words"] for p in got) == size and all(p["times"] == 1 for p in got):
                        out.append(text)
                        continue
                    w, kept = _WORDS.findall(text), []
                    for again in range(1, CAP + 1):
                        for p in got:
                            if p["times"] >= again:
                                at = max(0, p["block"] * BLOCK - offset)
                                kept += w[at : at + p["words"]]
                    out.append(" ".join(kept))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["_row", "mix"])

    given = pairs.select("_row", "offset", "size", "parts")
    schema = f"_row {given.schema['_row'].dataType.simpleString()}, mix string"
    out = given.mapInArrow(words, schema)
    new = {"text": F.col("mix")} | ({"n_chars": F.length("mix").cast(dict(docs.dtypes)["n_chars"])} if "n_chars" in columns else {})
    return out.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in columns])
