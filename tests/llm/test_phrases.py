"""Collocations against counts over all pieces in plain Python."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runlens.llm import phrases

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [re.findall("[^ \t]+", p) for p in re.split("[.,;:!?\n-\r]", (text or "").translate(UP))]


def brute(rows, support=10, swallow=50, limit=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        for ws in pieces(text):
            n[lang or "und"] += len(ws)
            f.update((lang or "und", tuple(ws[i:i + k])) for k in (1, 2, 3) for i in range(len(ws) - k + 1))
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= support}
    rows = {}
    for (g, w), a in found.items():
        score, _, l, r = min((10**6 * a * a // (f[g, w[:k]] * f[g, w[k:]]), k, f[g, w[:k]], f[g, w[k:]]) for k in range(1, len(w)))
        inside = [v for (h, x), v in found.items() if h == g and len(x) > len(w) and any(x[i:i + len(w)] == w for i in range(len(x) - len(w) + 1))] if len(w) == 2 else []
        if not any(100 * v >= swallow * a for v in inside):
            rows.setdefault(g, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((g, i, p.decode(), -a, l, r, n[g], -s) for g, x in rows.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:limit], 1))


def frame(spark, rows):
    return spark.createDataFrame([(t, g, 0, 0) for t, g in rows], "text string, lang string, n int, chunk int")  # clashing columns


def test_cases(spark):
    texts = ["The big red. Dog, the BIG red dog\nruns\trun"] * 14 + ["a a a a a a a a a a a a a", "x y;" * 30, "é ü ß. É ü ß" * 12]
    rows = [(t, g) for t in texts for g in ("en", None, "und")] + [(None, "en"), ("", None), (" ,.\r\x0b ", "en"), ("\x1c w \x85 w" * 20, "en")]
    rows += [("hot copy of one line " * 9, "en")] * 200 + [("w " * 50_000 + "z" * 200_000, "fr")]
    got = phrases.collocations(frame(spark, rows)).collect()
    want = brute(rows)
    assert sorted(map(tuple, got)) == want and len(want) > 20
    few = phrases.collocations(frame(spark, rows), support=3, swallow=90, limit=4, modulus=2, filter_bits=512).collect()
    assert sorted(map(tuple, few)) == brute(rows, 3, 90, 4)


def test_empty(spark):
    assert phrases.collocations(frame(spark, [("a", "b")]).limit(0)).count() == 0
    assert phrases.collocations(frame(spark, [(None, None)])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abAB .,\n\t", max_size=60), max_size=4), st.integers(1, 5))
def test_every_ngram_has_one_chunk(texts, modulus):
    """The chunks' own n-grams are those of the texts, each once."""
    chunks, row = phrases.parse([t.encode() for t in texts], modulus) if texts else (pa.array([], pa.string()), [])
    if not len(chunks):
        assert not any(ws for t in texts for ws in pieces(t))
        return
    batch = pa.RecordBatch.from_arrays([pa.array(["x"] * len(chunks)), chunks.cast(pa.string()), pa.array([1] * len(chunks))], ["lang", "chunk", "n"])
    c = phrases._Chunks(batch)
    for n in (1, 2, 3):
        want = Counter(" ".join(ws[i:i + n]) for t in texts for ws in pieces(t) for i in range(len(ws) - n + 1))
        at, weight = c.counted(c.runs(n), n)
        assert dict(zip(c.phrases(at, n).to_pylist(), weight.tolist())) == want


def test_filter_leaves_no_shuffle_files(spark):
    """Of the hashes' own shuffle and the filter's, nothing stays on disk."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {x for x in manager.getAllBlocks().mkString(" ").split() if x.startswith("shuffle_")}

    before = shuffled()
    hashes = spark.range(5000).groupBy((F.col("id") % 997).alias("h")).count().select("h")
    held = phrases.bit_filter(hashes, 1 << 12)
    assert phrases.holds(held.value, np.arange(997).astype(np.uint64)).all()
    assert shuffled() <= before
