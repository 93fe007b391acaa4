"""Near-duplicate groups by b-bit MinHash.

A document's set holds the hashes of its word shingles. ``BANDS * ROWS`` minima
give its band keys (full minima) and its signature, ``BITS`` low bits of each
minimum, packed. Documents with equal sets are one node. Nodes that share a band
are candidates; the similarity estimated from equal signature fields, corrected
for chance collisions, drops the hopeless ones (five standard errors below the
threshold), and the links that remain are confirmed on full sets.

Large buckets don't emit their pairs. Each node is first tested against one
other, the most central (its buckets hold most) of its buckets' leaders; links
merge nodes into components, and the nodes of buckets that still hold several
components go on. Among these, similar sets must share one of their rarest
shingles, early enough in both to leave room for the overlap that a link needs;
the pairs of different components that do are estimated and confirmed like the
first ones. So copies of one text meet by what only few of them have, not by
what all of them have, and a pair is left out only if its nodes are in one
component already, which its link could not change, or if it cannot be a link.

A pair at the threshold shares no band with probability (1 - 0.8**ROWS)**BANDS,
3e-6. Exact copies of any number are joined by the hash of their set.

Defined cases: documents without words (null or empty text) link with nothing;
rows without an id link with nothing and have no component; rows that repeat an
id are one node; extra columns are kept by ``deduplicated`` and not read else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import cut, word_hash
from runlens.llm.graph import components

#: Bands of full minima, and bits kept of each minimum.
BANDS, ROWS, BITS = 32, 5, 2

_HASHES = BANDS * ROWS
_RNG = np.random.default_rng(41)
_A = (_RNG.integers(0, 2**32, _HASHES, dtype=np.uint32) | np.uint32(1))[:, None]
_B = _RNG.integers(0, 2**32, _HASHES, dtype=np.uint32)[:, None]
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word n-grams (A-Z lower-cased; a short text is one)."""
    found = (text or "").encode().lower().split()  # bytes: ASCII case and white space only
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(word_hash.__getitem__, found), np.uint64, len(found))
    n = max(1, len(h) - words + 1)
    out = np.full(n, np.uint64(min(len(h), words)))
    for i in range(min(words, len(h))):
        out = (out ^ h[i : i + n]) * _P
        out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, packed low bits of the minima) of a non-empty set."""
    x, least = (s >> np.uint64(32)).astype(np.uint32), None
    for at in range(0, len(x), 2048):
        low = (_A * x[None, at : at + 2048] + _B).min(1)
        least = low if least is None else np.minimum(least, low)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _Q
    for column in least.reshape(BANDS, ROWS).T.astype(np.uint64):
        key = (key ^ column) * _P
        key ^= key >> np.uint64(29)
    bits = (least[:, None] >> np.arange(BITS, dtype=np.uint32) & 1).astype(np.uint8)
    return key.view(np.int64), np.packbits(bits.reshape(-1)).view(np.int64)


def signed(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, set_key, bands and sig of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, key, bands, sig = [], [], [], []
            for text in b.column(1).to_pylist():
                s = shingles(text, words)
                n.append(len(s))
                some = len(s) > 0
                key.append(hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if some else None)
                keys, packed = signature(s) if some else (None, None)
                bands.append(keys)
                sig.append(packed)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(key, pa.string()), pa.array(bands, pa.list_(pa.int64())),
                 pa.array(sig, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_key", "bands", "sig"])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, n_shingles long, set_key string, bands array<long>, sig array<long>")


def likely(percent: int) -> Column:
    """Whether the estimate of two nodes (a_n, a_sig, b_n, b_sig) allows a similarity of ``percent``."""
    fields = sum(1 << BITS * i for i in range(64 // BITS))
    fields -= (fields >> 63) << 64
    differ = F.lit(0)
    for i in range(_HASHES * BITS // 64):
        x = F.get("a_sig", F.lit(i)).bitwiseXOR(F.get("b_sig", F.lit(i)))
        any_bit = x
        for k in range(1, BITS):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(x, k))
        differ = differ + F.bit_count(any_bit.bitwiseAND(F.lit(fields)))
    chance, want = 2.0**-BITS, percent / 100
    equal = chance + (1 - chance) * want  # expected share of equal fields at the threshold
    error = (equal * (1 - equal) / _HASHES) ** 0.5
    estimate = (1 - differ / _HASHES - chance) / (1 - chance)
    sizes = F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent
    return sizes & (estimate >= want - 5 * error / (1 - chance))


def _sides(pairs: DataFrame, nodes: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``pairs`` (a, b) with ``columns`` of both nodes, prefixed."""
    for side in "ab":
        own = nodes.select(F.col("id").alias(side), *[F.col(c).alias(f"{side}_{n}") for c, n in columns.items()])
        pairs = pairs.join(own, side)
    return pairs


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have a similarity of at least ``percent``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _sides(pairs, sets, {"shingles": "set"}).select("a", "b", "a_set", "b_set").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(id, shingles) of the rows whose id is in ``wanted``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t, words).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(wanted, "id", "left_semi")
    return rows.mapInArrow(run, "id long, shingles array<long>").dropDuplicates(["id"])


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("component", F.col("id"))
    return members.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _rarest(sets: DataFrame, ids: DataFrame, percent: int) -> DataFrame:
    """(key, id, n, pos): the rarest shingles of each of the nodes ``ids``, rarest first.

    Sets of n and m shingles that are similar enough share at least ``percent`` %
    of either, so if each is sorted by the same order, they have one in common
    among the first n - percent% * n + 1 of either. Counts are among ``ids``; a
    shingle that only one of them has matches nothing.
    """
    held = sets.join(ids, "id", "left_semi").select("id", F.size("shingles").alias("n"), F.explode("shingles").alias("key"))
    common = held.groupBy("key").agg(F.count("*").alias("_df"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("_df", "key")) - 1
    first = F.col("n") - F.ceil(F.col("n") * percent / 100)
    return held.join(common, "key").withColumn("pos", place).where((F.col("pos") <= first) & (F.col("_df") > 1)).drop("_df")


def linked(nodes: DataFrame, sets_of, percent: int) -> DataFrame:
    """(id, component) of the nodes (id, n, bands, sig) that are not their component's least id."""
    rows = nodes.select("id", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1")
    members = cut(rows.join(shared, "key"))
    central = members.groupBy("id").agg(F.sum("_n").alias("central"))
    facts = cut(nodes.join(central, "id").select("id", "n", "sig", "central"))
    sets = cut(sets_of(facts.select("id")))

    def links(pairs: DataFrame) -> DataFrame:
        hopeful = _sides(pairs.distinct(), facts, {"n": "n", "sig": "sig"}).where(likely(percent)).select("a", "b")
        return cut(confirmed(hopeful, sets, percent))

    # each bucket's most central member leads it; a node is tested against the most central of its leaders
    ranked = members.select("key", "id").join(facts.select("id", F.struct("central", (-F.col("id")).alias("_minus")).alias("_rank")), "id")
    leaders = cut(ranked.groupBy("key").agg(F.max("_rank").alias("_lead")))
    best = members.join(leaders, "key").groupBy("id").agg((-F.max("_lead")["_minus"]).alias("_leader")).where("id <> _leader")
    star = best.select(F.least("id", "_leader").alias("a"), F.greatest("id", "_leader").alias("b"))
    found = links(star)
    labels = components(found)
    several = (_labelled(members.select("key", "id"), labels).groupBy("key")
               .agg(F.min("component").alias("_low"), F.max("component").alias("_high")).where("_low < _high"))
    open_ = members.join(several, "key").select("id").distinct()
    now = cut(_labelled(_rarest(sets, open_, percent), labels))
    sizes = now.groupBy("key", "component").agg(F.count("*").alias("_n"))
    mixed = (sizes.groupBy("key").agg(F.max_by("component", F.struct("_n", "component")).alias("main"), F.count("*").alias("_k"))
             .where("_k > 1").select("key", "main"))
    left = cut(now.join(mixed, "key"))
    one = left.where("component <> main").select("key", F.col("id").alias("a"), F.col("component").alias("_ca"), F.col("n").alias("_na"), F.col("pos").alias("_pa"))
    other = left.select("key", "main", F.col("id").alias("b"), F.col("component").alias("_cb"), F.col("n").alias("_nb"), F.col("pos").alias("_pb"))
    # a pair's first common shingle leaves at most this many to share; other common ones only see less
    most = F.least(F.col("_na") - F.col("_pa"), F.col("_nb") - F.col("_pb"))
    enough = most * (100 + percent) >= (F.col("_na") + F.col("_nb")) * percent
    pairs = one.join(other, "key").where((F.col("_ca") != F.col("_cb")) & ((F.col("_cb") == F.col("main")) | (F.col("a") < F.col("b"))) & enough)
    last = links(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    if not last.limit(1).count():
        return labels
    # the first links as stars around their component's least node
    return components(last.unionByName(labels.select(F.col("component").alias("a"), F.col("id").alias("b"))))


def groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of ``docs`` (doc_id, text)."""
    base = cut(signed(docs, words))
    some = base.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    classes = cut(some.groupBy("set_key").agg(F.min("doc_id").alias("id")))
    firsts = (some.join(classes.withColumnRenamed("set_key", "_set"), (F.col("doc_id") == F.col("id")) & (F.col("set_key") == F.col("_set")))
              .select("id", F.col("n_shingles").alias("n"), "bands", "sig").dropDuplicates(["id"]))
    labels = linked(firsts, lambda wanted: _sets(docs, wanted, words), percent)
    named = _labelled(classes, labels).select("set_key", "component")
    joined = base.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"),
                         F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group: the smallest id's (its first row, if rows repeat)."""
    found = cut(groups(docs, words, percent))
    gone = found.where("NOT kept").select("doc_id").distinct()
    repeated = found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id")
    left = docs.join(gone, "doc_id", "left_anti")
    several = left.join(repeated, "doc_id", "left_semi")
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64(*docs.columns))
    return left.join(repeated, "doc_id", "left_anti").unionByName(
        several.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")).select(*docs.columns)
