import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.llm import vafile


def brute(rows, every, k=5):
    seen = {}
    for v, e in rows:
        if v is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            seen.setdefault((v, tuple(math.floor(256 * x) for x in e)))
    out = []
    for q, a in seen:
        if q % every == 0:
            got = sorted((-sum(x * y for x, y in zip(a, b)), v) for v, b in seen if v != q and len(a) == len(b))[:k]
            out += [(q, i + 1, v, -s) for i, (s, v) in enumerate(got)]
    return sorted(out)


def run(df, every):
    return sorted(tuple(r) for r in vafile.top_k(df, F.col("vec_id") % every == 0).collect())


@pytest.mark.parametrize("blocks", [(4096, 2048, 64), (37, 5, 3)])
def test_brute_force(spark, tables, monkeypatch, blocks):
    for name, v in zip(("ENTRIES", "QUERIES", "FIRST"), blocks, strict=True):
        monkeypatch.setattr(vafile, name, v)
    df = tables("embeddings", "0.01")
    assert run(df, 50) == brute([(r.vec_id, r.embedding) for r in df.collect()], 50)


def test_cases(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25]) for _ in range(2)]) for i in range(80)]
    rows += [(3, rows[3][1]), (100, None), (110, [1.0, None]), (120, [float("nan"), 1.0]), (130, [float("inf"), 0.0]),
             (None, [1.0, 1.0]), (140, [0.5, 0.5, 0.5]), (141, [0.5, 0.5, 1.5]), (150, [1e6, 1e6]), (160, [-1e6, 3.0]), (170, [])]
    df = spark.createDataFrame([(v, e, "clash", 7) for v, e in rows], "vec_id long, embedding array<double>, score string, rank int")
    assert run(df, 10) == brute(rows, 10)
    assert vafile.top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_bounds_skip_most_vectors():
    rng = np.random.default_rng(1)
    e, q = rng.integers(-100, 100, (3000, 16)), rng.integers(-100, 100, (9, 16))
    for i, best in enumerate(vafile.search(e, q, 6)):
        s = e @ q[i]
        assert set(best) == set(np.flatnonzero(s >= np.sort(s)[-6]))
