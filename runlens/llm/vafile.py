"""Exact top-k inner products with vector-approximation files.

Vectors become integers, floor(256 * x) per component. Equal vectors are one
entry with their ``k + 1`` smallest ids, which is all that any query can need.
Entries and distinct query vectors are dealt into blocks, and each pair of an
entry block and a query block is one bounded task. There, every dimension of the
block is cut into ``CELLS`` cells; the scan reads only the cells and gives each
entry an upper bound of its score. Exact vectors are then read in bound order:
the first few set the score to beat, and only entries whose bound reaches it are
read after that, so the k-th result is certain. Blocks' best rows merge in a
window whose limit runs before the shuffle.

Defined cases: vectors that are null or hold null or non-finite components, and
rows without an id, take no part; vectors are compared with those of their own
length; a row repeated with the same id counts once, and a query skips all rows
of its id; ties go to the smaller id; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Entries and queries of a block; cells per dimension; entries read first.
ENTRIES, QUERIES, CELLS, FIRST = 4096, 2048, 64, 64
#: Queries whose bounds are held at once.
STEP = 64


def integers(col: str = "embedding") -> Column:
    """floor(256 * x) of each component; null if any component is null or not finite."""
    x = F.transform(F.col(col), lambda v: v.cast("double"))
    ok = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(ok, F.transform(x, lambda v: F.floor(F.lit(256.0) * v).cast("long")))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: floating-point ones while every sum is below 2**53."""
    peak = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if peak < 2**53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


def search(entries: np.ndarray, queries: np.ndarray, k: int) -> list[np.ndarray]:
    """Per query, the entries (indices) with a score of at least its k-th highest."""
    low, high = entries.min(0), entries.max(0)
    width = (high - low) // CELLS + 1
    cells = ((entries - low) // width).astype(np.uint8)  # the approximation file
    corner = low + cells.astype(np.int64) * width
    found = []
    for at in range(0, len(queries), STEP):
        q = queries[at : at + STEP]
        bound = _products(q, corner) + _products(np.clip(q, 0, None), (width - 1)[None, :])
        for i, upper in enumerate(bound):
            best = np.arange(len(upper))
            if len(upper) > max(FIRST, k):
                best = np.argpartition(upper, -max(FIRST, k))[-max(FIRST, k):]
                beat = np.partition(_products(q[i : i + 1], entries[best])[0], -k)[-k]
                best = np.flatnonzero(upper >= beat)
            score = _products(q[i : i + 1], entries[best])[0]
            if len(score) > k:
                best = best[score >= np.partition(score, -k)[-k]]
            found.append(best)
    return found


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` best other rows of ``vectors`` (vec_id, embedding)."""
    rows = (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), integers().alias("vec"), is_query.alias("q"))
            .where("vec IS NOT NULL AND vec_id IS NOT NULL"))
    near = Window.partitionBy("vec").orderBy("vec_id")
    entries = (rows.withColumn("_n", F.dense_rank().over(near)).where(F.col("_n") <= k + 1)
               .groupBy("vec").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")))  # k + 1 at most
    queries = rows.where("q").select(F.col("vec_id").alias("query_id"), "vec").distinct()
    distinct = queries.select("vec").distinct()
    n, m = entries.count(), distinct.count()
    entry_blocks, query_blocks = max(1, -(-n // ENTRIES)), max(1, -(-m // QUERIES))

    def dealt(df: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        return (df.withColumn(own, F.pmod(F.xxhash64("vec"), F.lit(blocks)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))))

    both = (dealt(entries, "eb", entry_blocks, "qb", query_blocks)
            .unionByName(dealt(distinct, "qb", query_blocks, "eb", entry_blocks), allowMissingColumns=True)
            .withColumn("dim", F.size("vec")))

    def block(t: pa.Table) -> pa.Table:
        vec, ids = t.column("vec").combine_chunks(), t.column("ids").combine_chunks()
        matrix = vec.flatten().to_numpy(zero_copy_only=False).reshape(len(vec), -1)
        entry = ids.is_valid().to_numpy(zero_copy_only=False)
        own, q = np.flatnonzero(entry), np.flatnonzero(~entry)
        out: list[tuple[int, int, int]] = []
        if len(own) and len(q):
            members = ids.take(pa.array(own)).to_pylist()
            for i, best in zip(q, search(matrix[own], matrix[q], k + 1), strict=True):
                scores = _products(matrix[i : i + 1], matrix[own[best]])[0]
                pairs = [(-int(s), v) for s, b in zip(scores, best, strict=True) for v in members[b]]
                out += [(int(i), v, -s) for s, v in sorted(pairs)[: k + 1]]
        at, found, score = (pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else ([], [], [])))
        return pa.table({"vec": vec.take(at), "vec_id": found, "score": score})

    best = both.groupBy("eb", "qb", "dim").applyInArrow(block, "vec array<long>, vec_id long, score long")
    order = [F.desc("score"), F.col("vec_id")]
    best = (best.withColumn("_n", F.row_number().over(Window.partitionBy("vec").orderBy(*order)))
            .where(F.col("_n") <= k + 1).drop("_n"))
    mine = Window.partitionBy("query_id").orderBy(*order)
    return (queries.join(best, "vec").where("query_id <> vec_id")
            .withColumn("rank", F.row_number().over(mine)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
