import hashlib
import re

import pytest

from runlens.llm import iblt

P = re.compile(rf"[^\n.!?]{{1,{iblt.PIECE_CHARS}}}[.!?]*")


def pieces(t):
    found = {p.strip(" ") for p in P.findall(t)} - {""}
    return found or ({t} if t else set())


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        third = len(t) // 3
        edited = t[: len(t) - third] + nxt[:third]
        near = []
        for other in (edited, nxt):
            a, b = pieces(t), pieces(other)
            near.append(len(a & b) / len(a | b) if a | b else 1.0)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), *map(pytest.approx, near)))
    return out


def run(df):
    return [(r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in iblt.fingerprints(df).collect()]


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))


def test_brute_force(spark, tables):
    df = tables("documents", "0.01")
    assert by_id(run(df)) == by_id(brute([(r.doc_id, r.text) for r in df.collect()]))


def test_larger_sizes_after_failure(spark, tables, monkeypatch):
    monkeypatch.setattr(iblt, "ROOM", 0.1)
    monkeypatch.setattr(iblt, "STEPS", 3)
    df = tables("documents").where("doc_id < 40")
    assert by_id(run(df)) == by_id(brute([(r.doc_id, r.text) for r in df.collect()]))


def test_cases(spark):
    rows = [(5, "Same text. And more!\nLine"), (4, "Same text. And more!\nLine"), (3, None), (2, ""), (9, "...\n!"), (7, "ab"), (6, "é🙂" * 500),
            (None, "no id here."), (1, "x. " * 40_000 + "tail"), (0, " \n ")]
    df = spark.createDataFrame([(i, t, "clash", -1) for i, t in rows], "doc_id long, text string, fingerprint string, part int")
    found = iblt.fingerprints(df).collect()
    assert by_id([(r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in found]) == by_id(brute(rows))
    got = {r.doc_id: r for r in found}
    assert got[5].fingerprint == got[4].fingerprint != got[6].fingerprint and got[5].near_next == 1
    assert iblt.fingerprints(df.limit(0)).count() == 0
    twice = run(df.where("doc_id = 5").union(df.where("doc_id = 5")))
    assert len(twice) == 2 and all(r[1] == 25 and r[4] == 1 for r in twice)
