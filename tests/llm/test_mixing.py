import re

import numpy as np
import pytest
from pyspark.sql import Row

from runlens.llm import mixing as mx

W = re.compile(mx.WORD)


def brute_targets(size):
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(size.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(2 * size[s] for s in capped)
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level > 2 * size[s]}
        if not over:
            return {s: 2.0 * size[s] if s in capped else weight[s] * level for s in order}
        capped |= over


def check(rows, docs):
    size = {}
    for r in docs:
        size[r.source] = size.get(r.source, 0) + len(W.findall(r.text or ""))
    want, source = brute_targets(size), {r.doc_id: r.source for r in docs}
    taken = dict.fromkeys(size, 0)
    assert len(rows) == len(docs)
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in size:
        assert abs(taken[s] - want[s]) <= 2.5 * mx.BLOCK, (s, taken[s], want[s])


def test_against_brute_force(tables):
    docs = tables("documents", "0.01")
    rows = mx.plan(docs).collect()
    check(rows, docs.collect())
    assert sorted(rows) == sorted(mx.plan(docs.repartition(5)).collect())


def test_permutation():
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        assert sorted(mx.permuted(np.arange(n), n, 3)) == list(range(n))
    assert list(mx.permuted(np.arange(1000), 1000, 1)) != list(mx.permuted(np.arange(1000), 1000, 2))


def test_cases(spark):
    rows = [Row(doc_id=i, text=f"w{i} x " * (i * 20), source=["a", "b", None, "zero"][i % 4] if i % 4 < 3 else "zero", sid="clash", size=-1, n_chars=0) for i in range(40)]
    rows = [r if r.source != "zero" else Row(**(r.asDict() | {"text": None if r.doc_id % 8 == 3 else " \n"})) for r in rows]
    rows.append(Row(doc_id=99, text="long " * 200_000, source="b", sid="", size=0, n_chars=0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, sid string, size int, n_chars long")
    check(mx.plan(docs).collect(), rows)
    mix = mx.mixed(docs)
    assert mix.columns == docs.columns
    plan = {r.doc_id: r for r in mx.plan(docs).collect()}
    got = {r.doc_id: r for r in mix.collect()}
    assert set(got) == {k for k, r in plan.items() if r.taken}
    text = {r.doc_id: r.text for r in rows}
    for k, r in got.items():
        assert len(W.findall(r.text)) == plan[k].taken and r.n_chars == len(r.text) and r.sid in ("clash", "")
        if plan[k].taken == 2 * plan[k].size:
            assert r.text.split() == text[k].split() * 2
        assert set(r.text.split()) <= set(text[k].split())
    assert mx.plan(docs.limit(0)).count() == 0 and mx.mixed(docs.limit(0)).count() == 0


def test_repeated_rows(spark):
    rows = [(1, "a b c " * 50, "s")] * 3 + [(None, "d e " * 40, None)] * 2 + [(None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mx.plan(docs).collect()
    assert sorted(r.size for r in got) == [0, 80, 80, 150, 150, 150]
    assert sum(len(W.findall(r.text)) for r in mx.mixed(docs).collect()) == sum(r.taken for r in got)


def test_mix_is_sent_on_in_slices_of_one_text_a_row(spark, arrow_maps):
    rows = [(i, f"w{i} " * (i % 200 + 1), "s", i) for i in range(2 * mx.ROWS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int").coalesce(1)
    got = mx.mixed(docs).collect()
    assert len(got) > mx.ROWS
    given, join = arrow_maps[-1]
    assert given.columns == ["_row", "offset", "size", "parts"]
    sent = list(join(iter(given.toArrow().combine_chunks().to_batches())))
    assert max(b.num_rows for b in sent) <= mx.ROWS
    texts = {r["doc_id"]: t for b in sent for r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
    assert texts == {r.doc_id: r.text for r in got}
