import random
import re

import numpy as np
import pytest

from runlens.llm import graph
from runlens.llm import minhash as mh


def sets(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def brute(rows, n, percent=80):
    own = [(i, sets(t, n)) for i, t in rows]
    up = {i: i for i, _ in own}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = {}
    for i, s in own:
        for g in s:
            holders.setdefault(g, []).append(i)
    by = dict(own)
    near = {(a, b) for g in holders.values() if len(g) < 400 for a in g for b in g if a < b}
    for a, b in near:
        both = len(by[a] & by[b])
        if 100 * both >= percent * (len(by[a]) + len(by[b]) - both):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in own)


def run(df, n):
    return sorted(tuple(r) for r in mh.groups(df, n).collect())


@pytest.mark.parametrize("words", [4, 5])
def test_brute_force(tables, words):
    df = tables("documents", "0.01")
    assert run(df, words) == brute([(r.doc_id, r.text) for r in df.collect()], words)


def test_chains_and_large_groups(spark):
    rng, rows = random.Random(8), []
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    text = list(base)
    for _ in range(60):  # a chain: neighbours alike, ends not
        rows.append((len(rows), " ".join(text)))
        text[rng.randrange(120)] = f"n{len(rows)}"
    for _ in range(150):  # variants of one text, at differing distances
        t = [f"q{i}" for i in range(80)]
        for _ in range(rng.randrange(5)):
            t[rng.randrange(80)] = f"z{rng.randrange(10**6)}"
        rows.append((len(rows), " ".join(t)))
    rows += [(len(rows) + i, "Same  SAME text here twice over") for i in range(50)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = run(df, 4)
    want = brute(rows, 4)
    assert got == want


def test_cases(spark):
    long = "a b c d e f g " * 60_000
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one TWO"), (6, "É x"), (7, "é x"), (8, long), (9, long + "tail"), (10, "one two three four"), (10, "one two three four")]
    df = spark.createDataFrame([(i, t, "clash", "en", -1) for i, t in rows] + [(None, "one two", "", "en", 0)], "doc_id long, text string, sig string, lang string, kept int")
    found = mh.groups(df, 4).collect()
    got = {r.doc_id: tuple(r) for r in found}
    assert len(found) == 12
    assert got[None] == (None, 1, None, True)
    assert got[1] == (1, 0, 1, True) and got[3] == (3, 0, 3, True)
    assert got[5] == (5, 1, 4, False) and got[7] == (7, 1, 7, True)
    assert got[9][2] == 8 and got[10] == (10, 1, 10, True)
    kept = mh.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, 6, 7, 8, 10, None], key=str)
    assert mh.deduplicated(df.limit(0)).count() == 0


def test_estimate_follows_similarity(spark):
    rng = np.random.default_rng(3)
    pairs = []
    for percent in (20, 50, 70, 80, 90):
        for _ in range(20):
            n = 400
            both = int(2 * n * percent / (100 + percent))
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            b = np.unique(np.r_[a[:both], rng.integers(0, 2**63, n - both).astype(np.uint64)])
            pairs.append((percent, len(a), mh.signature(a)[1].tolist(), len(b), mh.signature(b)[1].tolist()))
    df = spark.createDataFrame(pairs, "p int, a_n long, a_sig array<long>, b_n long, b_sig array<long>")
    found = df.select("p", mh.likely(80).alias("ok")).groupBy("p").agg({"ok": "count"}).collect()
    ok = {r.p: r[1] for r in df.where(mh.likely(80)).groupBy("p").count().collect()}
    assert len(found) == 5 and ok.get(80, 0) == ok.get(90, 0) == 20 and ok.get(20, 0) == 0 == ok.get(50, 0)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 480)] + [(1000, i) for i in range(1001, 1200)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    want = sorted((x, find(x)) for x in up if find(x) != x)
    assert sorted(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect())) == want
