"""Document fingerprints as invertible Bloom lookup sketches, with SQL functions only.

A text's paragraph pieces (sentences and lines, cut after ``PIECE_CHARS``
characters) are hashed; the set of digests goes into a sketch of three
sub-tables, where a cell holds the number of its digests, their XOR and the XOR
of their check values. The fingerprint is the sketch at ``SMALL`` cells a
sub-table, in hexadecimal. To compare two texts, their sketches of one larger
size are subtracted cell by cell, and peeling recovers the digests that differ:
a cell left with one digest gives it away and it is taken out of its other
cells. Each step takes the cells of one sub-table, in which a digest stands once,
so a step is one aggregation; the rows stay dealt by document throughout. What
doesn't peel is tried again with twice the cells until everything does.
Likeness is common digests over all digests.

Defined cases: a null text is empty; empty texts have no digests and are alike
(1.0) only among themselves; a text without letters of a piece is one digest;
rows are ordered by descending id (nulls last, ties by text hash), so repeated
rows are next to each other; a single row is its own next one; other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import cut, shuffle_parts, text_of

#: Longest piece; cells of a sub-table in the fingerprint.
PIECE_CHARS, SMALL = 128, 4
#: Cells of a sub-table per digest of both texts; steps before a larger size is tried.
ROOM, STEPS = 0.75, 9
#: Digests of all pairs that one task peels; results (28 bytes each) that may be broadcast.
DIGESTS, BROADCAST_ROWS = 100_000, 1_000_000

_PIECE = rf"[^\n.!?]{{1,{PIECE_CHARS}}}+[.!?]*+"
_ROW = ["part", "nth"]


def digests(text: Column) -> Column:
    """The distinct digests of the text's pieces."""
    pieces = F.filter(F.transform(F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0)), lambda p: F.trim(p)),
                      lambda p: p != "")
    keys = F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p)))
    return F.when((F.size(keys) == 0) & (text != ""), F.array(F.xxhash64(text))).otherwise(keys)


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(77))


def _cell(key: Column, sub: Column | int, width: Column | int, level: int = 0) -> Column:
    sub, width = (F.lit(x) if isinstance(x, int) else x for x in (sub, width))
    return (sub * width + F.pmod(F.xxhash64(key, sub.cast("int"), F.lit(level)), width)).cast("long")


def fingerprint(keys: Column) -> Column:
    """The sketch at ``SMALL`` cells a sub-table: count, XOR and check XOR of each cell, in hex."""
    zero = F.lit(0).cast("long")

    def cell(c: Column) -> Column:
        own = F.filter(keys, lambda k: _cell(k, F.floor(c / SMALL), SMALL) == c)
        xor = F.aggregate(own, zero, lambda a, k: a.bitwiseXOR(k))
        check = F.aggregate(own, zero, lambda a, k: a.bitwiseXOR(_check(k)))
        return F.concat(F.hex(F.size(own)), F.lit("."), F.hex(xor), F.lit("."), F.hex(check))

    return F.concat_ws("-", F.transform(F.sequence(zero, F.lit(3 * SMALL - 1).cast("long")), cell))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, keys of each row, those of the next row by descending id, and its place (part, nth).

    Ranges of ids make the parts; a part's last row gets the first row of the
    next part as a copy, so one shuffle of the texts is enough.
    """
    spark = docs.sparkSession
    parts = max(2, shuffle_parts(spark))
    bounds = sorted({int(x) for x in docs.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 1 / (4 * parts))}) \
        if docs.where("doc_id IS NOT NULL").limit(1).count() else []
    text = text_of()
    part = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<long>"), lambda b: b > F.col("doc_id")))
    part = F.when(F.col("doc_id").isNull(), len(bounds)).otherwise(part)
    rows = docs.select("doc_id", text.alias("text")).withColumns({"part": part, "hash": F.xxhash64("text")})
    place = F.struct(F.col("doc_id").isNull(), -F.col("doc_id"), F.col("hash"))
    firsts = {r.part: r.first for r in rows.groupBy("part").agg(F.min(place).alias("first")).collect()}  # one row a part
    order = sorted(firsts)
    before = {p: order[i - 1] for i, p in enumerate(order)}  # the last part comes before the first one
    # a part's number is at most ``parts``: these arrays are as short
    ids = F.array(*[F.lit(firsts[p][1] if p in firsts else None).cast("long") for p in range(len(bounds) + 1)])
    hashes = F.array(*[F.lit(firsts[p][2] if p in firsts else None).cast("long") for p in range(len(bounds) + 1)])
    earlier = F.array(*[F.lit(before.get(p)).cast("int") for p in range(len(bounds) + 1)])
    first = F.get(hashes, "part").eqNullSafe(F.col("hash")) & F.get(ids, "part").eqNullSafe(-F.col("doc_id"))
    copies = F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("copy")))
    copies = F.when(first, F.concat(copies, F.array(F.struct(F.get(earlier, "part").alias("part"), F.lit(True).alias("copy"))))).otherwise(copies)
    dealt = (rows.withColumn("keys", digests(F.col("text"))).withColumn("_at", F.explode(copies))
             .drop("part").select("*", "_at.part", "_at.copy").drop("_at"))
    w = Window.partitionBy("part").orderBy("copy", F.col("doc_id").desc_nulls_last(), "hash")
    return (dealt.withColumns({"next_text": F.lead("text").over(w), "next_keys": F.lead("keys").over(w), "nth": F.row_number().over(w)})
            .where("NOT copy").drop("copy", "hash"))


def _cells(base: DataFrame, level: int) -> DataFrame:
    """Cells of the subtracted sketches of every pair: (row, pair, width, cell, n, key, check)."""
    def side(pair: int, sign: int, keys: str, a: str, b: str) -> Column:
        width = (F.ceil((F.size(a) + F.size(b)) * ROOM) + 2) * 2**level
        return F.struct(F.lit(pair).alias("pair"), F.lit(sign).cast("long").alias("n"), width.cast("long").alias("width"), F.col(keys).alias("keys"))

    sides = F.array(side(0, 1, "keys", "keys", "edited_keys"), side(0, -1, "edited_keys", "keys", "edited_keys"),
                    side(1, 1, "keys", "keys", "next_keys"), side(1, -1, "next_keys", "keys", "next_keys"))
    total = base.agg(F.sum(2 * F.size("keys") + F.size("edited_keys") + F.size("next_keys"))).first()[0] or 0
    parts = max(shuffle_parts(base.sparkSession), -(-int(total) // DIGESTS))
    rows = (base.select(*_ROW, "keys", "edited_keys", "next_keys").repartition(parts, *_ROW)
            .select(*_ROW, F.explode(sides).alias("s")).select(*_ROW, "s.pair", "s.n", "s.width", F.explode("s.keys").alias("key"))
            .withColumn("check", _check(F.col("key"))).withColumn("sub", F.explode(F.array(*map(F.lit, range(3)))))
            .withColumn("cell", _cell(F.col("key"), F.col("sub"), F.col("width"), level)))
    return _summed(rows)


def _summed(rows: DataFrame) -> DataFrame:
    """Cells with anything in them; cell -1 counts what has been recovered."""
    return (rows.groupBy(*_ROW, "pair", "width", "cell")
            .agg(F.sum("n").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("check").alias("check"))
            .where("n <> 0 OR key <> 0 OR check <> 0"))


def _step(cells: DataFrame, sub: int, level: int) -> DataFrame:
    """Takes the digests that stand alone in a cell of the sub-table out of the other sub-tables."""
    key, n, width = F.col("key"), F.col("n"), F.col("width")
    alone = (F.abs(n) == 1) & (F.col("cell") >= 0) & (F.floor(F.col("cell") / width) == sub) & (F.col("check") == _check(key))

    def entry(cell: Column, n: Column, key: Column, check: Column) -> Column:
        return F.struct(cell.cast("long").alias("cell"), n.cast("long").alias("n"), key.cast("long").alias("key"), check.cast("long").alias("check"))

    none = F.lit(0)
    out = [entry(_cell(key, i, width, level), -n, key, F.col("check")) for i in range(3) if i != sub]
    out = F.when(alone, F.array(entry(F.lit(-1), F.lit(1), none, none), *out)).otherwise(F.array(entry(F.col("cell"), n, key, F.col("check"))))
    return _summed(cells.select(*_ROW, "pair", "width", F.explode(out).alias("o")).select(*_ROW, "pair", "width", "o.*"))


def differences(base: DataFrame) -> DataFrame:
    """Per row, the number of digests in which it differs from its edited text (d0) and its next row (d1)."""
    found, level = None, 0
    while True:
        cells = _cells(base, level)
        for i in range(STEPS + 3 * level):
            cells = _step(cells, i % 3, level)
        got = lambda pair: F.sum(F.when((F.col("pair") == pair) & (F.col("cell") < 0), F.col("n")).otherwise(0))
        tried = cut(cells.groupBy(*_ROW).agg(got(0).alias("d0"), got(1).alias("d1"), F.max("cell").alias("left")))
        done = tried.where("left < 0").drop("left")
        found = done if found is None else found.unionByName(done)
        failed = tried.where("left >= 0").select(*_ROW)
        if not failed.limit(1).count():
            return found
        base, level = base.join(failed, _ROW, "left_semi"), level + 1


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row."""
    size = F.length("text")
    third = F.floor(size / 3).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), size - third), F.col("next_text").substr(F.lit(1), third))
    base = (with_next(docs).withColumn("edited", edited)
            .withColumns({"n_chars": size.cast("long"), "edited_sha256": F.sha2(F.col("edited"), 256), "edited_keys": digests(F.col("edited"))})
            .drop("text", "edited", "next_text"))
    base = cut(base)

    def near(keys: str, d: str) -> Column:
        both, apart = F.size("keys") + F.size(keys), F.coalesce(F.col(d), F.lit(0))
        return F.when(both == 0, F.lit(1.0)).otherwise(((both - apart) / (both + apart)).cast("double"))

    found = differences(base)
    if found.count() <= BROADCAST_ROWS:  # checked: at most 28 MB; beyond it a shuffled join
        found = F.broadcast(found)
    return (base.join(found, _ROW, "left")
            .select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("keys")).alias("fingerprint"),
                    fingerprint(F.col("edited_keys")).alias("edited_fingerprint"),
                    near("edited_keys", "d0").alias("near_edited"), near("next_keys", "d1").alias("near_next")))
