"""Phrase collocations by prefix-free parsing.

A text becomes a row of tokens: its words, and a break where a piece ends. The
row is cut wherever two neighbouring tokens hash to a trigger value. A chunk runs
from one trigger pair through the next, so neighbours overlap by that pair, and
equal passages fall into equal chunks wherever they stand. The dictionary holds
every distinct chunk once with the number of times that it occurs in the
language; n-grams are counted inside the distinct chunks with that weight. An
n-gram of up to three words belongs to the chunk in which it starts before the
closing pair, so none in an overlap counts twice.

Counting goes from short to long, and no phrase is lost on the way: a phrase
reaches the support only if all shorter ones in it do. Frequent words, then the
hashes of frequent word pairs, go into a bit filter of fixed size; what a filter
lets through by mistake is dropped by the exact counts at the end.

Defined cases: null texts are empty, a null language counts as ``und``, repeated
rows and ids count each row, ties in rank follow (count, phrase bytes), other
columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import first_rows, join_weighted, shuffles_freed, stored

_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_BREAK = b"."
#: Byte map of a text: A-Z lower-cased, tabs to spaces, every piece end to a break.
_MAP = bytes.maketrans(_UPPER + b"\t" + b".,;:!?\n\x0b\x0c\r", _LOWER + b" " + _BREAK * 10)
#: One token pair in this many is a trigger.
MODULUS = 32
#: Bits of a filter (16 MB), whatever the corpus.
FILTER_BITS = 1 << 27
#: Text bytes that a task takes up at once (one longer text or chunk is still taken whole).
GATHER = 3 << 20
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def spaced(text: bytes) -> bytes:
    """Words and breaks of a text between spaces, with two breaks at its end."""
    return (text.translate(_MAP).replace(_BREAK, b" . ") + b" . .").lstrip()


class _Tokens:
    """The tokens of texts in one row: ``code`` numbers the distinct ones, ``hash`` is each one's hash."""

    def __init__(self, texts: pa.Array):
        rows = pc.ascii_split_whitespace(texts)
        self.lengths = np.diff(rows.offsets.to_numpy())
        found = rows.flatten().dictionary_encode()
        self.distinct = found.dictionary
        self.code = found.indices.to_numpy().astype(np.int64)
        names = self.distinct.cast(pa.binary()).to_pylist()
        self.hash = np.fromiter(map(crc32, names), np.uint64, len(names))[self.code]
        self.word = self.code != (names.index(_BREAK) if _BREAK in names else -1)


def _pairs(h: np.ndarray) -> np.ndarray:
    """64-bit hashes of neighbouring tokens."""
    x = (h[:-1] + _A) * _B ^ (h[1:] + _B) * _A
    x ^= x >> np.uint64(31)
    return x * _C ^ (x >> np.uint64(29))


def _ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin[i], begin[i] + 1, ... of each range, one after the other."""
    return np.arange(length.sum()) + np.repeat(begin - np.cumsum(length) + length, length)


def parse(texts: list[bytes], modulus: int = MODULUS) -> tuple[pa.Array, np.ndarray]:
    """The chunks of the texts in order, and which text each is of. All but the
    last two tokens of a chunk are its own."""
    t = _Tokens(pa.array([spaced(x) for x in texts], pa.binary()).cast(pa.string()))
    after = np.cumsum(t.lengths)
    first, last = after - t.lengths, after - 2
    at = np.flatnonzero(_pairs(t.hash) % np.uint64(modulus) == 0)
    row = np.searchsorted(after, at, "right")
    inside = (at > first[row]) & (at < last[row])
    some = np.flatnonzero(first < last)  # texts with tokens of their own
    begin, row = np.concatenate([first[some], at[inside]]), np.concatenate([some, row[inside]])
    order = np.argsort(begin)
    begin, row = begin[order], row[order]
    end = np.append(begin[1:], 0)
    end[np.flatnonzero(np.diff(row, append=-1))] = last[some]
    length = end - begin + 2
    toks = t.distinct.take(pa.array(t.code[_ranges(begin, length)]))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)), pa.int32()), toks), " "), row


def _gathered(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``GATHER`` bytes of a column."""
    held, size = [], 0
    for b in batches:
        for at in range(0, b.num_rows, 1024):
            part = b.slice(at, 1024)
            held.append(part)
            size += pc.sum(pc.binary_length(part.column(column))).as_py() or 0
            if size >= GATHER:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def dictionary(docs: DataFrame, modulus: int = MODULUS) -> DataFrame:
    """(lang, chunk, n): the distinct chunks of each language and how often each occurs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _gathered(batches, 1):
            found, row = parse(b.column(1).cast(pa.binary()).to_pylist(), modulus)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), found], ["lang", "chunk"])

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return (rows.mapInArrow(run, "lang string, chunk string")
            .groupBy("lang", "chunk").agg(F.count("*").alias("n")))


class _Chunks(_Tokens):
    """The chunks of a batch in one row of tokens, and which tokens are their own."""

    def __init__(self, b: pa.RecordBatch):
        super().__init__(b.column(1))
        self.weight = np.repeat(b.column(2).to_numpy(), self.lengths)
        langs = b.column(0).dictionary_encode()
        self.names = langs.dictionary
        self.lang = np.repeat(langs.indices.to_numpy().astype(np.int64), self.lengths)
        # the two tokens that close a chunk belong to the next one
        self.start = self.word.copy()
        ends = np.cumsum(self.lengths)
        self.start[ends - 1] = self.start[ends - 2] = False

    def seeded(self) -> np.ndarray:
        """Word hashes, different for every language."""
        return self.hash + _seeds(self.names)[self.lang]

    def runs(self, n: int) -> np.ndarray:
        """Positions where ``n`` words in a row start that belong to the chunk."""
        at = np.flatnonzero(self.start[:len(self.start) - n + 1])
        for i in range(1, n):
            at = at[self.word[at + i]]
        return at

    def counted(self, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """One position of each distinct (language, n-gram) among ``at``, and its weight."""
        key = self.lang[at]
        for i in range(n):
            if i:  # numbers below the count of positions, so the next product fits
                key = np.unique(key, return_inverse=True)[1]
            key = key * len(self.code) + self.code[at + i]
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        return at[first], np.bincount(which, self.weight[at], len(first)).astype(np.int64)

    def phrases(self, at: np.ndarray, n: int) -> pa.Array:
        toks = [self.distinct.take(pa.array(self.code[at + i])) for i in range(n)]
        return pc.binary_join_element_wise(*toks, " ") if n > 1 else toks[0]


def _seeds(langs: pa.Array) -> np.ndarray:
    return np.array([crc32(x.encode()) << 32 for x in langs.to_pylist()], np.uint64)


def _counted(chunks: DataFrame, find) -> DataFrame:
    """(lang, phrase, f): the n-grams that ``find`` names ((positions, n) of a batch's chunks)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _gathered(batches, 1):
            c = _Chunks(b)
            for at, n in find(c):
                at, f = c.counted(at, n)
                yield pa.RecordBatch.from_arrays([c.names.take(pa.array(c.lang[at])), c.phrases(at, n),
                                                  pa.array(f)], ["lang", "phrase", "f"])

    rows = chunks.mapInArrow(run, "lang string, phrase string, f long")
    return rows.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def words(chunks: DataFrame) -> DataFrame:
    """(lang, phrase, f): occurrences of every word."""
    return _counted(chunks, lambda c: [(c.runs(1), 1)])


def pair_hashes(chunks: DataFrame, frequent, support: int) -> DataFrame:
    """(h): hashes of word pairs that may reach the support, of pairs of frequent words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _gathered(batches, 1):
            c = _Chunks(b)
            h = c.seeded()
            at, good = c.runs(2), holds(frequent.value, h)
            at = at[good[at] & good[at + 1]]
            found, which = np.unique(_pairs(h)[at], return_inverse=True)
            n = np.bincount(which, c.weight[at], len(found)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["h", "n"])

    rows = chunks.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return rows.where(F.col("n") >= support).select("h")


def long_phrases(chunks: DataFrame, pairs) -> DataFrame:
    """(lang, phrase, f) of two and three words, all of whose pairs pass the filter."""
    def find(c: _Chunks) -> list[tuple[np.ndarray, int]]:
        good = np.append(holds(pairs.value, _pairs(c.seeded())), False)
        two, three = c.runs(2), c.runs(3)
        return [(two[good[two]], 2), (three[good[three] & good[three + 1]], 3)]

    return _counted(chunks, find)


def _slots(h: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(h * m >> np.uint64(32)) % np.uint64(bits) for m in (_A, _B)]


def holds(filter_bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each hash."""
    out = np.ones(len(h), bool)
    for s in _slots(h, len(filter_bits) * 8):
        out &= (filter_bits[s >> np.uint64(3)] >> (s & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return out


def bit_filter(hashes: DataFrame, bits: int = FILTER_BITS):
    """A broadcast filter of ``bits`` bits over the column ``h``: its size never grows with the data."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for b in batches:
            h = b.column(0).to_numpy().view(np.uint64)
            for s in _slots(h, bits):
                np.bitwise_or.at(own, s >> np.uint64(3), np.uint8(1) << (s & np.uint64(7)).astype(np.uint8))
        longs = own.view(np.int64)
        at = np.flatnonzero(longs)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(longs[at])], ["at", "bits"])

    with shuffles_freed(hashes.sparkSession):  # of ``hashes`` too: the filter is all that stays of them
        rows = hashes.mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits"))
        found = rows.toArrow()  # at most bits / 64 rows
    whole = np.zeros(bits // 64, np.int64)
    whole[found["at"].to_numpy()] = found["bits"].to_numpy()
    return hashes.sparkSession.sparkContext.broadcast(whole.view(np.uint8))


def _word_hashes(frequent: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column(0).dictionary_encode()
            h = np.fromiter(map(crc32, b.column(1).cast(pa.binary()).to_pylist()), np.uint64, b.num_rows)
            h += _seeds(langs.dictionary)[langs.indices.to_numpy()]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    return frequent.select("lang", "phrase").mapInArrow(run, "h long")


def _whole(c: str) -> Column:
    return F.col(c).cast("decimal(19,0)").cast("decimal(38,0)")


def collocations(docs: DataFrame, support: int = 10, swallow: int = 50, limit: int = 2000,
                 modulus: int = MODULUS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The best phrases of two and three words of each language.

    ``support``: least occurrences of a candidate; a candidate inside a longer one
    that has at least ``swallow`` per cent of its occurrences is dropped; ``limit``
    phrases a language are returned: lang, rank, phrase, a, l, r, n, score.
    """
    chunks = stored(dictionary(docs, modulus), "chunks")
    every = stored(words(chunks), "words")
    sizes = every.groupBy("lang").agg(F.sum("f").alias("n"))
    total = every.agg(F.sum("f")).first()[0] or 0
    frequent = every.where(F.col("f") >= support)
    pairs = bit_filter(pair_hashes(chunks, bit_filter(_word_hashes(frequent), filter_bits), support), filter_bits)
    found = stored(long_phrases(chunks, pairs).where(F.col("f") >= support)
                   .withColumn("w", F.split("phrase", " ")), "phrases")
    parts = stored(frequent.select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"))
                   .unionByName(found.where(F.size("w") == 2)
                                .select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"))), "parts")

    def joined(k: Column) -> Column:
        return F.array_join(k, " ")

    cuts = found.select("lang", "phrase", F.col("f").alias("a"), "w",
                        F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.slice("w", F.lit(1), F.col("k"))).alias("first"),
                       joined(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k"))).alias("rest"))
    # a part has at most a tenth of its occurrences as phrases that it starts or ends
    for side, name in (("first", "l"), ("rest", "r")):
        cuts = join_weighted(cuts.withColumnRenamed(side, "part"), parts, ["lang", "part"], "part_f", 3 * total)
        cuts = cuts.drop("part").withColumnRenamed("part_f", name)
    scored = cuts.withColumn("_a", _whole("a")).withColumn("_lr", _whole("l") * _whole("r"))
    scored = scored.withColumn("score", F.expr("(1000000BD * _a * _a) div _lr"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    best = best.select("lang", "phrase", "a", "b.l", "b.r", "b.score")

    w3 = found.where(F.size("w") == 3)
    inner = F.explode(F.array(joined(F.slice("w", 1, 2)), joined(F.slice("w", 2, 2))))
    longer = w3.select("lang", F.col("f").alias("outer"), inner.alias("phrase")).groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(
        F.coalesce(100 * F.col("outer") < swallow * F.col("a"), F.lit(True))).drop("outer")

    top = first_rows(kept, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], limit)
    return (top.withColumn("rank", F.col("_n").cast("long")).join(sizes, "lang")
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
