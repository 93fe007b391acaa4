"""Removal of repeated word windows by recompression.

A text's words are compressed in rounds that name runs of equal symbols and
pairs of neighbours. A name depends only on what it stands for and a pair is
formed only by a hash bit of its two symbols, so names are the same in every
document and equal passages are cut alike but for their borders (a run's name
has no length: a passage may cut a run). Two rounds are enough here: a border
between two symbols of the second round is decided by at most three words on
either side, and among the eight inner gaps of any ``WINDOW`` words there is such
a border unless runs take up the room. The least named border of a window is its
anchor; equal windows have equal anchors wherever they stand. Windows that runs
leave without a border are their own anchors.

Texts are taken up half a megabyte at a time: their words are found, hashed and cut
as one sequence, with gaps between two texts.

Spark finds the names that stand in more than one document, and for each the
classes of occurrences that have the same ten words to either side. All of a
class but its first document repeat every window around the name. Where a name
has several classes, the first document of each gives its windows themselves,
which are verified by their own hashes. Names have 48 bits, classes 32 more;
what a window is told by is its own 64-bit hash beside its name. Whole copies of
a document are told by a hash of their words and take no part in this.

Hot passages: first documents are minima, combined before the shuffle; the joins
that bring them back can be split where one key is skewed.

Defined cases: null text has no words; documents shorter than a window keep all;
rows without an id are left as they are and count as nobody's first; rows that
repeat an id are one document as to who is first; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import cut, stored

#: Words of a window; words on either side that may decide a border; words looked at in one step.
WINDOW, REACH, STEP = 13, 3, 1 << 20
#: Sums of neighbouring hashes that are taken at once; rows of windows that are sent on at once.
SUMS, ROWS = 1 << 14, 1 << 14
#: Bytes and rows of text taken up together: a text alone has too few words for numpy's calls to be free.
BYTES, TEXTS = 1 << 19, 1 << 12
#: Bytes of a word from which on it is hashed by itself; words hashed at once.
LONG, WORDS = 64, 1 << 15
#: Ids (8 bytes each) that may be broadcast to thin out the texts before their shuffle.
BROADCAST_IDS = 2_000_000

_U = np.uint64
_P, _Q = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)
_GAPS = WINDOW - 2 * REACH + 1  # inner gaps of a window: offsets REACH .. WINDOW - REACH
_SIDE = WINDOW - REACH  # words on either side that the windows around an anchor reach
_RNG = np.random.default_rng(7)
_AROUND = _RNG.integers(1, 2**63, 2 * _SIDE).astype(_U) | _U(1)
_WINDOW = _RNG.integers(1, 2**63, WINDOW).astype(_U) | _U(1)
_NONE = _U(2**64 - 1)
_EMPTY, _NO_ROW = np.zeros(0, _U), np.zeros(0, np.int64)
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)  # the first k of eight bytes


def _name(a: np.ndarray, b) -> np.ndarray:
    b = np.atleast_1d(b)  # arrays wrap around silently
    x = (a ^ b >> _U(31)) * _P + b * _Q
    return x ^ x >> _U(32)


def _changes(a: np.ndarray) -> np.ndarray:
    """Whether each element differs from the one before; the first does."""
    out = np.ones(len(a), bool)
    np.not_equal(a[1:], a[:-1], out=out[1:])
    return out


def _sums(h: np.ndarray, start: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The weighted sum of the hashes from each start on, modulo 2**64: a product of a few thousand
    starts at a time."""
    if not len(start):
        return _EMPTY
    each = sliding_window_view(h, len(weights))
    return np.concatenate([each[start[at : at + SUMS]] @ weights for at in range(0, len(start), SUMS)])


def _round(name: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Names runs, then pairs; returns (name, start, end) of the symbols."""
    first = np.flatnonzero(_changes(name))
    last = np.append(first[1:], len(name)) - 1
    base, start, end = name[first], start[first], end[last]
    run = np.where(last > first, _name(base, _U(1)), base)
    low = base * _Q >> _U(63) == 0  # the side of a run is that of its symbol
    pair = np.zeros(len(low), bool)
    np.greater(low[:-1], low[1:], out=pair[:-1])
    alone = np.ones(len(low), bool)
    np.logical_not(pair[:-1], out=alone[1:])
    keep = np.flatnonzero(alone)
    out, both = run[keep], np.flatnonzero(pair[keep])
    out[both] = _name(run[keep[both]], run[keep[both] + 1] ^ _Q)
    return out, start[keep], end[keep + pair[keep]]


def _slice(h: np.ndarray):
    """(first window, last window, name, surrounding) of each anchor of ``h``, by position."""
    n, m = len(h), len(h) - WINDOW + 1
    at = np.arange(n)
    name, start, end = _round(h, at, at + 1)
    # a border of the second round: its two symbols neither make a run nor a pair
    low = name * _Q >> _U(63) == 0
    i = np.flatnonzero((name[:-1] != name[1:]) & ~(low[:-1] & ~low[1:]))
    gap, left, right = start[i + 1], start[i] - 1, end[i + 1] + 1
    ok = (gap - left <= REACH) & (right - gap <= REACH) & (left >= 0) & (right <= n)
    i, gap, left, right = i[ok], gap[ok], left[ok], right[ok]
    key = _name(_name(name[i], name[i + 1]), _name(h[left], h[right - 1]))
    # least border of each window, its place packed into the low bits
    least = np.full(n + 1, _NONE)
    named = np.zeros(n + 1, _U)
    least[gap] = key >> _U(24) << _U(24) | gap.astype(_U)
    named[gap] = key
    wide, reach = least[REACH:], 1
    while reach < _GAPS:
        more = min(reach, _GAPS - reach)
        wide, reach = np.minimum(wide[: len(wide) - more], wide[more:]), reach + more
    wide = wide[:m]
    s0 = np.flatnonzero(_changes(wide) | (wide == _NONE))
    s1 = np.append(s0[1:], m) - 1
    own = wide[s0] == _NONE
    g = np.where(own, 0, (wide[s0] & _U(0xFFFFFF)).astype(np.int64))
    names = named[g]
    padded = np.zeros(n + 2 * _SIDE, _U)
    padded[_SIDE : _SIDE + n] = h
    around = _sums(padded, g, _AROUND)
    if own.any():
        w = window_hashes(h, s0[own])
        names[own], around[own] = _name(w, _U(3)), w
    return s0, s1, names >> _U(16), (around ^ around >> _U(29)) & _U(0x7FFFFFFF), np.where(own, s0 + REACH, g)


def window_hashes(h: np.ndarray, start: np.ndarray) -> np.ndarray:
    out = _sums(h, start, _WINDOW)
    return out ^ out >> _U(31)


def anchors(h: np.ndarray) -> Iterator[tuple]:
    """(offset, hashes, ``_slice``) of each step of a document; steps share what windows at their ends need."""
    if len(h) < WINDOW:
        return
    for at in range(0, len(h) - 2 * REACH + 1, STEP):
        before = min(at, 2 * WINDOW)
        part = h[at - before : at + STEP + 3 * WINDOW]
        found = _slice(part)
        own = (found[4] >= before + REACH) & (found[4] < before + STEP + REACH)
        yield at - before, part, *(x[own] for x in found)


def _ids(name: np.ndarray, around: np.ndarray) -> np.ndarray:
    """One number for each pair of name and class."""
    return _name(np.asarray(name, _U), np.asarray(around, _U) ^ _Q)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _space(data: np.ndarray) -> np.ndarray:
    """Which bytes are ASCII white space."""
    return (data == 32) | (data - np.uint8(9) < 5)


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words ``data[start:end]``, eight bytes at a time; no two words of the same size
    up to eight bytes have the same."""
    eight = np.ndarray(len(data) + 1, "<u8", np.append(data, np.zeros(8, np.uint8)), strides=(1,))  # from each byte on
    size = end - start
    out = size.astype(_U) * _Q
    for at in range(0, len(start), WORDS):
        part, some, left = out[at : at + WORDS], start[at : at + WORDS], size[at : at + WORDS]
        which = np.flatnonzero(left < LONG)
        some, left = some[which], left[which]
        while len(which):
            x = part[which] ^ eight[some] & _HEAD[np.minimum(left, 8)]
            x *= _P
            x ^= x >> _U(29)
            x *= _Q
            part[which] = x ^ x >> _U(32)
            more = np.flatnonzero(left > 8)
            which, some, left = which[more], some[more] + 8, left[more] - 8
    for i in np.flatnonzero(size >= LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]])
    return out


class Texts:
    """Some rows of a column of texts: their bytes, where each word starts and ends in them, and which words
    (``of[i]`` to ``of[i + 1]``) are row i's. ``h`` holds the hashes of all words, at ``at``, with zeros between
    two rows, as far as a window's surrounding reaches: what is found at valid windows of a row is what would be
    found in the row alone."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        self.data, space = data, _space(data)
        word = ~space
        first, last = word.copy(), word.copy()
        first[1:] &= space[:-1]
        last[:-1] &= space[1:]
        filled = ends[1:] > ends[:-1]  # a row's first and last byte have no neighbours outside it
        for edge, border in (first, ends[:-1][filled]), (last, ends[1:][filled] - 1):
            edge[border] = word[border]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.of = np.searchsorted(self.start, ends)
        self.n = np.diff(self.of)
        self.lo = self.of[:-1] + _SIDE * np.arange(len(self.n))
        self.at = np.arange(len(self.start)) + _SIDE * np.repeat(np.arange(len(self.n)), self.n)
        self.h = np.zeros(len(self.start) + _SIDE * len(self.n), _U)
        self.h[self.at] = _hashes(data, self.start, self.end)

    def anchors(self) -> Iterator[tuple]:
        """As ``anchors`` of all rows, cut down to windows that lie in a row, which comes second."""
        last = self.lo + self.n - WINDOW
        for base, h, s0, s1, name, around, g in anchors(self.h):
            row = np.searchsorted(self.lo, g + base, "right") - 1
            s0, s1 = np.maximum(s0, self.lo[row] - base), np.minimum(s1, last[row] - base)
            ok = np.flatnonzero(s0 <= s1)
            yield base, row[ok], h, s0[ok], s1[ok], name[ok], around[ok], g[ok]

    def digests(self, keep: np.ndarray | None = None) -> list[str]:
        """SHA-256 of each row's words (those of ``keep``, if given), joined by one space."""
        start, end, of = self.start, self.end, self.of
        if keep is not None:
            start, end, of = start[keep], end[keep], np.append(0, np.cumsum(keep))[of]
        joined = np.ones(len(start), bool)  # to the word before, so the byte before is white space
        joined[of[:-1][of[:-1] < of[1:]]] = False
        start = start - joined
        edge = np.zeros(len(self.data) + 1, np.int8)
        edge[start] = 1
        edge[end] -= 1
        out = np.where(_space(self.data), np.uint8(32), self.data)[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
        ends = np.append(0, np.cumsum(end - start))[of].tolist()
        return [hashlib.sha256(out[a:b]).hexdigest() for a, b in zip(ends, ends[1:])]


def texts(column: pa.Array) -> Iterator[tuple[int, Texts]]:
    """The texts of ``column`` (null: empty), so many at a time, each time with the first one's row."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data or b"", np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(ends, ends[at] + BYTES, "right")) - 1
        to = min(max(to, at + 1), at + TEXTS, len(column))
        yield at, Texts(data[ends[at] : ends[to]], ends[at : to + 1] - ends[at])
        at = to


def _spread(s0: np.ndarray, s1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the ranges, each with the number of its range."""
    n = s1 - s0 + 1
    i = np.repeat(np.arange(len(n)), n)
    return i, s0[i] + np.arange(len(i)) - (np.cumsum(n) - n)[i]


def _listed(column: pa.Array, at: int, rows: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The structs in the lists of some rows: (row, fields)."""
    part = column.slice(at, rows)
    values = part.flatten()
    return np.repeat(np.arange(rows), pc.list_value_length(part).to_numpy()), [x.to_numpy() for x in values.flatten()]


def _places(wanted: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which ``keys`` are in ``wanted`` (ascending), and where there."""
    if not len(wanted):
        return _NO_ROW, _NO_ROW
    j = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
    i = np.flatnonzero(wanted[j] == keys)
    return i, j[i]


def _base(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, whole_sha256, names and arounds (distinct pairs) of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sha, names, arounds, sizes = [], [], [], [], [np.zeros(1, np.int64)]
            for _, t in texts(b.column(1)):
                found = [(x[1], x[5], x[6]) for x in t.anchors()]
                row, name, around = (np.concatenate(x) for x in zip((_NO_ROW, _EMPTY, _EMPTY), *found, strict=True))
                order = np.argsort(row.astype(_U) << _U(48) | _ids(name, around) >> _U(16))
                row, name, around = row[order], name[order], around[order]
                new = _changes(row) | _changes(name) | _changes(around)
                n.append(t.n)
                sha += t.digests()
                names.append(name[new])
                arounds.append(around[new])
                sizes.append(np.bincount(row[new], minlength=len(t.n)))
            ends = pa.array(np.cumsum(np.concatenate(sizes)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in
                     (_signed(np.concatenate([_EMPTY, *names])), np.concatenate([_EMPTY, *arounds]).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate([_NO_ROW, *n])), pa.array(sha, pa.string()), *lists],
                                             ["doc_id", "n_words", "whole_sha256", "names", "arounds"])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, n_words long, whole_sha256 string, names array<long>, arounds array<int>")


def _texts(docs: DataFrame, wanted: DataFrame, per: DataFrame) -> DataFrame:
    """text of the rows whose id is in ``per`` (doc_id, ...), with its columns; ``wanted``: the ids."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if wanted.count() <= BROADCAST_IDS:  # checked: at most 16 MB; beyond it the join below shuffles all texts
        rows = rows.join(F.broadcast(wanted), "doc_id", "left_semi")
    return rows.join(per.hint("merge"), "doc_id")


def _windows(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(name, around, off, window, doc): the windows around each class (name, around, doc), from its document."""
    per = cut(classes.groupBy("doc").agg(F.collect_list(F.struct("name", "around")).alias("at")).withColumnRenamed("doc", "doc_id"))

    def batch(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        cols = [pa.array(np.concatenate(x)) for x in zip(*held, strict=True)]
        return pa.RecordBatch.from_arrays(cols, ["name", "around", "off", "window", "doc"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            ids = b.column(0).to_numpy()
            for at, t in texts(b.column(1)):
                row, pairs = _listed(b.column(2), at, len(t.n))
                wanted = np.unique(_name(_ids(*pairs), row.astype(_U)))
                for _, row, h, s0, s1, name, around, g in t.anchors():
                    keys = _name(_ids(name, around), row.astype(_U))
                    i, j = _places(wanted, keys)
                    i = i[np.unique(j, return_index=True)[1]]
                    each, s = _spread(s0[i], s1[i])
                    i = i[each]
                    held.append([_signed(name[i]), around[i].astype(np.int32), (g[i] - s).astype(np.int32), _signed(window_hashes(h, s)), ids[at + row[i]]])
                    rows += len(i)
                    if rows >= ROWS:  # a text's few rows alone would cost more to send than to find
                        yield batch(held)
                        held, rows = [], 0
        if held:
            yield batch(held)

    given = _texts(docs, per.select("doc_id"), per).select("doc_id", "text", "at")
    return given.mapInArrow(run, "name long, around int, off int, window long, doc long")


def _removed(docs: DataFrame, per: DataFrame) -> DataFrame:
    """doc_id, whole_sha256, n_removed and kept_sha256 of the rows in ``per`` (doc_id, at: name, around, mask)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole, gone, sha = [], [], []
            for at, t in texts(b.column(1)):
                row, (*pairs, masks) = _listed(b.column(2), at, len(t.n))
                wanted, place = np.unique(_name(_ids(*pairs), row.astype(_U)), return_index=True)
                cover = np.zeros(len(t.h) + 1, np.int64)
                for base, row, _, s0, s1, name, around, g in t.anchors():
                    i, j = _places(wanted, _name(_ids(name, around), row.astype(_U)))
                    each, s = _spread(s0[i], s1[i])
                    s = s[masks[place[j[each]]] >> (g[i[each]] - s) & 1 == 1] + base
                    np.add.at(cover, s, 1)
                    np.add.at(cover, s + WINDOW, -1)
                keep = np.cumsum(cover)[t.at] == 0
                whole += t.digests()
                gone += (t.n - np.diff(np.append(0, np.cumsum(keep))[t.of])).tolist()
                sha += t.digests(keep)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(whole, pa.string()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())],
                                             ["doc_id", "whole_sha256", "n_removed", "kept_sha256"])

    given = _texts(docs, per.select("doc_id"), per).select("doc_id", "text", "at")
    return given.mapInArrow(run, "doc_id long, whole_sha256 string, n_removed long, kept_sha256 string")


def _checked(rows: DataFrame) -> DataFrame:
    """``rows`` (two numbers at most) to be broadcast while they are few, else as they are."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row of ``docs`` (doc_id, text)."""
    base = stored(_base(docs), "names")
    known = base.where("doc_id IS NOT NULL")
    # whole copies: everything goes if there is a window at all
    first = cut(known.groupBy("whole_sha256").agg(F.min("doc_id").alias("first")))
    whole = F.xxhash64("whole_sha256").alias("whole")
    copies = cut(known.select("doc_id", "whole_sha256").join(first, "whole_sha256").where("first < doc_id").select("doc_id", whole).distinct())
    own = known.select("doc_id", whole, "names", "arounds").join(_checked(copies), ["doc_id", "whole"], "left_anti")
    each = own.select(F.col("doc_id").alias("doc"), F.explode(F.arrays_zip("names", "arounds")).alias("o"))
    each = each.select(F.col("o.names").alias("name"), F.col("o.arounds").alias("around"), "doc")
    shared = cut(each.groupBy("name").agg(F.min("doc").alias("_first"), F.max("doc").alias("_last"))
                 .where("_first < _last").select("name"))
    hits = stored(each.join(shared, "name"), "hits")
    classes = cut(hits.groupBy("name", "around").agg(F.min("doc").alias("doc")))
    every = (1 << WINDOW + 1) - 1
    later = hits.join(classes.withColumnRenamed("doc", "_first"), ["name", "around"]).where("_first < doc")
    later = later.select("doc", "name", "around", F.lit(every).alias("mask"))
    several = cut(classes.groupBy("name").agg(F.count("*").alias("_n")).where("_n > 1").select("name"))
    windows = stored(_windows(docs, classes.join(several, "name")), "windows")
    firsts = cut(windows.groupBy("name", "window").agg(F.min("doc").alias("_first"), F.max("doc").alias("_last")).where("_first < _last").drop("_last"))
    earlier = windows.join(firsts, ["name", "window"]).where("_first < doc")
    mask = F.sum(F.call_function("shiftleft", F.lit(1), F.col("off"))).cast("int")  # a window per offset
    earlier = earlier.select("doc", "name", "around", "off").distinct().groupBy("doc", "name", "around").agg(mask.alias("mask"))
    per = cut(later.unionByName(earlier).groupBy("doc").agg(F.collect_list(F.struct("name", "around", "mask")).alias("at")).withColumnRenamed("doc", "doc_id"))
    # rows that repeat id and words have the same result
    removed = _removed(docs, per).dropDuplicates(["doc_id", "whole_sha256"])
    gone = copies.select("doc_id", "whole", F.lit(True).alias("copy"))
    rows = (base.select("doc_id", "n_words", "whole_sha256", whole).join(removed, ["doc_id", "whole_sha256"], "left")
            .join(gone, ["doc_id", "whole"], "left"))
    copy = F.col("copy").isNotNull() & (F.col("n_words") >= WINDOW)
    return rows.select("doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
                       F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"))
