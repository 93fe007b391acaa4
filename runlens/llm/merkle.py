"""Merkle manifest of a dataset by time-forward processing.

Every row is a leaf; leaves of a source are ordered by id and hashed upwards,
``FANOUT`` at a time, to the source's subroot, and the subroots likewise to the
root. Nodes carry labels (level, place) that grow from child to parent. A sweep in
label order keeps a priority queue of messages ordered by the label they are sent
to: a node takes the digests of its children off the queue and sends its own to its
parent. A second sweep in reversed order sends each node's proof suffix (the
siblings from there to the root) to its children, down to the leaves.

The queue is external: between tasks it is a Spark shuffle sorted by label. A task
holds the messages of one block of ``FANOUT ** HEIGHT`` neighbours at a time, so a
tree of L levels takes L / HEIGHT shuffles up and as many down, each a
``FANOUT ** HEIGHT``-th of the last one; a source of any size is cut into blocks.

Defined cases: a null field is ``-``; a null source is a tree of its own and the
first; null ids come first, rows with equal ids follow their leaf digests, so
repeated rows are leaves side by side; a null id is never tampered with; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import stored
from runlens.operators.order import range_sorted

FANOUT = 3
#: Levels that one task walks in a block.
HEIGHT = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: A step of a proof: the siblings left and right of the node, as hex text.
STEP = pa.struct([("left", pa.string()), ("right", pa.string())])


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def fold(leaf: str, steps) -> str:
    """The root that a leaf digest and its proof lead to."""
    for s in steps:
        leaf = digest(s["left"] + leaf + s["right"])
    return leaf


def leaf_digest(fields: dict[str, Column]) -> Column:
    """Digest of a row: each field ``-`` if null, else byte count, ``:`` and value."""
    parts = []
    for c in fields.values():
        value = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def tamper(text: Column, doc_id: Column) -> Column:
    """The text without line breaks where 2 divides the crc32 of the id's decimal text."""
    even = F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, tampered) of every row."""
    whole = {c: F.col(c) for c in FIELDS}
    forged = whole | {"text": tamper(F.col("text"), F.col("doc_id"))}
    return docs.select("doc_id", "source", leaf_digest(whole).alias("leaf"), leaf_digest(forged).alias("tampered"))


def placed(nodes: DataFrame, tree: str, order: list[Column]) -> DataFrame:
    """``nodes`` with ``place`` (from 0) in their tree and its ``size``.

    Rows are range-sorted; a place is the row's place in its range and tree after the
    tree's rows in earlier ranges, so no task holds a tree and no join key is hot.
    """
    srt = range_sorted(nodes, [F.col(tree).asc_nulls_first(), *order])
    per = srt.groupBy("_rl_pid", tree).agg(F.count("*").alias("_n"), F.min("_rl_mid").alias("_first"))
    trees = Window.partitionBy(tree)
    before = trees.orderBy("_rl_pid").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("_rl_pid", F.col(tree).alias("_tree"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                     F.sum("_n").over(trees).alias("size"))
    rows = srt.join(per.withColumnRenamed("_rl_pid", "_pid"), (F.col("_rl_pid") == F.col("_pid")) & F.col(tree).eqNullSafe(F.col("_tree")))
    return rows.withColumn("place", F.col("_before") + F.col("_rl_mid") - F.col("_first")).drop(
        "_rl_pid", "_rl_mid", "_pid", "_tree", "_first", "_before")


def levels(size: int) -> int:
    """Levels above the nodes until one is left."""
    n = 0
    while size > 1:
        size, n = -(-size // FANOUT), n + 1
    return n


def sweep_up(digests: list[str], height: int) -> list[list[str]]:
    """Digests of a block level by level, after ``height`` levels of hashing runs."""
    out: list[list[str]] = [[] for _ in range(height + 1)]
    queue = [((0, i), 0, d) for i, d in enumerate(digests)]  # ascending labels: a heap
    while queue:
        label = queue[0][0]
        inputs = []
        while queue and queue[0][0] == label:
            inputs.append(heapq.heappop(queue)[2])
        level, place = label
        own = digest("".join(inputs)) if level else inputs[0]
        out[level].append(own)
        if level < height:
            heapq.heappush(queue, ((level + 1, place // FANOUT), place % FANOUT, own))
    return out


def sweep_down(block: list[list[str]], suffix: list) -> Iterator[tuple[int, list]]:
    """(place, proof) of the block's nodes; ``suffix`` is the proof of the block's own node."""
    top = len(block) - 1
    queue = [((-top, 0), suffix)]
    while queue:
        (level, place), proof = heapq.heappop(queue)
        level, place = -level, -place
        if not level:
            yield place, proof
            continue
        first = place * FANOUT
        run = block[level - 1][first:first + FANOUT]
        for i in range(len(run)):
            step = {"left": "".join(run[:i]), "right": "".join(run[i + 1:])}
            heapq.heappush(queue, ((1 - level, -(first + i)), [step, *proof]))


def _block(step: int) -> Column:
    return F.expr(f"place div {FANOUT ** step}").alias("block")


def _blocks(rows: DataFrame) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "place")


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """The rows of each (tree, block), batch by batch."""
    rows = (r for b in batches for part in range(0, b.num_rows, 4096) for r in b.slice(part, 4096).to_pylist())
    return groupby(rows, key=itemgetter("tree", "block"))


def _batched(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for r in rows:
        held.append(r)
        if len(held) == 4096:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    yield pa.RecordBatch.from_pylist(held, schema)


def raised(nodes: DataFrame, done: int, step: int) -> DataFrame:
    """(tree, size, place, digest): the nodes ``step`` levels up, or the trees' roots
    where that is nearer. ``done`` levels lie below ``nodes``, which hold ``size`` leaves a tree."""
    schema = pa.schema([("tree", pa.string()), ("size", pa.int64()), ("place", pa.int64()), ("digest", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parents() -> Iterator[dict]:
            for (tree, block), rows in _streamed(batches):
                block_rows = list(rows)  # FANOUT ** HEIGHT at most
                size = block_rows[0]["size"]
                top = sweep_up([r["digest"] for r in block_rows], min(step, max(0, levels(size) - done)))[-1]
                yield {"tree": tree, "size": size, "place": block, "digest": top[0]}

        yield from _batched(parents(), schema)

    rows = nodes.select("tree", "size", "place", "digest", _block(step))
    return _blocks(rows).mapInArrow(run, "tree string, size long, place long, digest string")


def _with_proofs(nodes: DataFrame, above: DataFrame, step: int, carried: list[str]) -> DataFrame:
    """Rows of ``nodes`` by block, each block led by its own node of ``above`` with that one's proof."""
    top = above.select("tree", F.col("place").alias("block"), F.lit(-1).cast("long").alias("place"), "proof", "subroot", "root")
    low = nodes.select("tree", "size", "place", "digest", _block(step), *carried)
    return _blocks(low.unionByName(top, allowMissingColumns=True))


def _proofs(batches: Iterator[pa.RecordBatch], done: int, step: int) -> Iterator[tuple[dict, dict, list]]:
    """(row, row of the block's own node, proof) of every node."""
    for _, rows in _streamed(batches):
        own = next(rows)
        below = list(rows)
        height = min(step, max(0, levels(below[0]["size"]) - done))
        for place, proof in sweep_down(sweep_up([r["digest"] for r in below], height), own["proof"]):
            yield below[place], own, proof


def lowered(nodes: DataFrame, above: DataFrame, done: int, step: int) -> DataFrame:
    """(tree, place, digest, proof, subroot, root) of ``nodes`` from those of the nodes above."""
    schema = pa.schema([("tree", pa.string()), ("place", pa.int64()), ("digest", pa.string()), ("proof", pa.list_(STEP)),
                        ("subroot", pa.string()), ("root", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(({"tree": r["tree"], "place": r["place"], "digest": r["digest"], "proof": proof,
                              "subroot": own["subroot"], "root": own["root"]}
                             for r, own, proof in _proofs(batches, done, step)), schema)

    return _with_proofs(nodes, above, step, []).mapInArrow(
        run, "tree string, place long, digest string, proof array<struct<left: string, right: string>>, subroot string, root string")


def verified(nodes: DataFrame, above: DataFrame, step: int) -> DataFrame:
    """The manifest's rows from the leaves and the proofs of the nodes above them."""
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("source", "leaf", "subroot", "root", "proof_sha256", "folded_root")),
                        ("verified", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for r, own, proof in _proofs(batches, 0, step):
                folded = fold(r["tampered"], proof)
                yield {"doc_id": r["doc_id"], "source": r["tree"], "leaf": r["digest"], "subroot": own["subroot"], "root": own["root"],
                       "proof_sha256": digest("".join(s["left"] + s["right"] for s in proof)), "folded_root": folded,
                       "verified": folded == own["root"]}

        yield from _batched(rows(), schema)

    return _with_proofs(nodes, above, step, ["doc_id", "tampered"]).mapInArrow(
        run, "doc_id long, source string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def _climb(nodes: DataFrame, name: str, step: int) -> tuple[list[DataFrame], DataFrame]:
    """The node tables from the leaves up, every ``step`` levels, and the trees' roots."""
    most = levels(nodes.agg(F.max("size")).first()[0] or 0)
    tables = [nodes]
    for done in range(0, max(most, 1), step):
        tables.append(stored(raised(tables[-1], done, step), f"{name}{done}"))
    return tables[:-1], tables[-1]


def manifest(docs: DataFrame, step: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, source of every row.

    ``step``: levels a task walks at a time.
    """
    named = stored(leaves(docs), "leaves")
    nodes = stored(placed(named, "source", [F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("tampered")])
                   .select(F.col("source").alias("tree"), "doc_id", "place", "size", F.col("leaf").alias("digest"), "tampered"), "placed")
    trees, subroots = _climb(nodes, "tree", step)
    # the sources are the leaves of one more tree
    tops = stored(placed(subroots.select(F.lit("").alias("top"), F.col("tree").alias("source"), F.col("digest")), "top",
                         [F.col("source").asc_nulls_first()])
                  .select(F.col("top").alias("tree"), "source", "place", "size", "digest"), "subroots")
    upper, root = _climb(tops, "top", step)

    above = root.select("tree", "place", "digest", F.expr("array()").cast("array<struct<left: string, right: string>>").alias("proof"),
                        F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    for done in range((len(upper) - 1) * step, -1, -step):
        above = lowered(upper[done // step], above, done, step)
    # a subroot's proof heads the proofs of its source
    above = (above.drop("subroot").withColumnRenamed("digest", "subroot").join(tops.select("place", "source"), "place")
             .select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("place"), "proof", "subroot", "root"))
    for done in range((len(trees) - 1) * step, 0, -step):
        above = lowered(trees[done // step], above, done, step)
    return verified(trees[0], above, step).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "source")
