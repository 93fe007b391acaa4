import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from runlens.llm import recompress as rc

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=13):
    first = {}
    for i, t in rows:
        w = W.findall(t or "")
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if i is not None:
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w = W.findall(t or "")
        gone = set()
        for s in range(len(w) - window + 1):
            if i is not None and first[tuple(w[s : s + window])] < i:
                gone |= set(range(s, s + window))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(df):
    return sorted((tuple(r) for r in rc.repeats(df).collect()), key=str)


def test_brute_force(spark, tables):
    """The test documents, and texts of few words, with runs and passages of all lengths."""
    rows = [(r.doc_id, r.text) for r in tables("documents", "0.01").collect()]
    rng, parts = random.Random(5), []
    few = []
    for i in range(300):
        kind, t = rng.random(), []
        for _ in range(rng.randrange(1, 8)):
            if parts and rng.random() < 0.5:
                p = rng.choice(parts)
                a = rng.randrange(len(p))
                t += p[a : a + rng.randrange(8, 40)]
            else:
                p = [rng.choice("ab" if kind < 0.3 else "abcdefgh") * (1 if kind < 0.8 else rng.randrange(1, 4)) for _ in range(rng.randrange(5, 30))]
                if rng.random() < 0.2:
                    p = p[:1] * rng.randrange(10, 40) + p
                parts.append(p)
                t += p
        few.append((10_000 + i, " ".join(t)))
    rows += few
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_cases(spark):
    p = " ".join(f"p{i}" for i in range(30))
    long = " ".join(str(i % 977) for i in range(50_000))
    rows = [(1, None), (2, ""), (3, p), (3, p), (4, f"x {p} y"), (None, p), (5, "a " * 40), (6, "a " * 14), (7, "a " * 12), (8, long), (9, long + " z"),
            (10, " ".join(p.split()[5:18])), (11, " ".join(p.split()[5:17])), (12, p.upper()), (3, "other " + p)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, names string, n_words int")
    assert run(df) == brute(rows)
    assert rc.repeats(df.limit(0)).count() == 0


def test_steps_agree(monkeypatch):
    rng = np.random.default_rng(1)
    h = rng.integers(0, 40, 3000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h[700:760] = h[700]

    def found():
        return sorted((b + int(s), int(n), int(a), b + int(x)) for b, _, s0, s1, name, around, g in rc.anchors(h)
                      for lo, hi, n, a, x in zip(s0, s1, name, around, g) for s in range(lo, hi + 1))

    whole = found()
    assert [x[0] for x in whole] == list(range(3000 - 12))
    monkeypatch.setattr(rc, "STEP", 100)
    assert [x[:2] + x[3:] for x in found()] == [x[:2] + x[3:] for x in whole]


def test_sums_equal_a_loop(monkeypatch):
    monkeypatch.setattr(rc, "SUMS", 7)
    rng = np.random.default_rng(2)
    h, start = rng.integers(0, 2**63, 500).astype(np.uint64) * np.uint64(3), rng.integers(0, 480, 60)
    want = np.zeros(60, np.uint64)
    for k, w in enumerate(rc._AROUND):
        want += h[start + k] * w
    assert np.array_equal(rc._sums(h, start, rc._AROUND), want)
    assert len(rc._sums(h, start[:0], rc._AROUND)) == 0


def test_windows_of_many_texts_are_sent_on_together(spark, arrow_maps):
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(200):
        a = rng.randrange(40)
        rows.append((i, " ".join([f"x{rng.random()}", *passage[a : a + 20], f"y{rng.random()}"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert run(docs) == brute(rows)
    given, find = arrow_maps[1]
    sent = list(find(iter(given.toArrow().combine_chunks().to_batches())))
    assert sum(b.num_rows for b in sent) > 1000 and len(sent) == 1


ODD = [None, "", " ", "a", " a  b\t\nc ", "b", "c\x0b\x0cd\r", "x\u00a0y \u2003 z\x85 \x1c\x1f", "a\0 a \0a \0", "w" * 63 + " " + "w" * 64 + " " + "w" * 65,
       "12345678 123456789 12345678a 1234567812345678 12345678 123456781234567", " ".join(f"q{i} " for i in range(12)), "", " ".join(f"q{i}" for i in range(13)),
       "q12 " + " ".join(f"q{i}" for i in range(40)), " ".join("ab"[i // 9 % 2] for i in range(90)), "e\u0301 \u4e2d\u6587 " * 20, None, "ends here ", " starts here", "v " * 70]


@pytest.mark.parametrize(("size", "rows"), [(1, 4096), (150, 3), (1 << 18, 4096)])
def test_texts_taken_up_together_are_as_alone(monkeypatch, size, rows):
    monkeypatch.setattr(rc, "BYTES", size)
    monkeypatch.setattr(rc, "TEXTS", rows)
    monkeypatch.setattr(rc, "WORDS", 5)
    column = pa.array(["cut off", *ODD, "cut off"]).slice(1, len(ODD))
    hashed, found, sha, dropped, at = {}, [], [], [], 0
    for first, t in rc.texts(column):
        assert first == at
        at += len(t.n)
        for lo, n, text in zip(t.lo, t.n, ODD[first:at], strict=True):
            words = W.findall(text or "")
            assert len(words) == n
            for word, h in zip(words, t.h[lo : lo + n].tolist(), strict=True):
                assert hashed.setdefault(word, h) == h
        sha += t.digests()
        dropped += t.digests(np.arange(len(t.start)) % 3 > 0 if size == 1 else np.zeros(len(t.start), bool))
        for base, row, _, s0, s1, name, around, g in t.anchors():
            found += sorted((first + r, lo, hi, n, a, x) for r, lo, hi, n, a, x in
                            zip(row.tolist(), (s0 + base - t.lo[row]).tolist(), (s1 + base - t.lo[row]).tolist(), name.tolist(), around.tolist(), (g + base - t.lo[row]).tolist(), strict=True))
    assert at == len(ODD) and len(set(hashed.values())) == len(hashed)

    def digest(words):
        return hashlib.sha256(" ".join(words).encode()).hexdigest()

    split = [W.findall(x or "") for x in ODD]
    assert sha == [digest(x) for x in split]
    assert dropped == [digest([w for i, w in enumerate(x) if i % 3] if size == 1 else []) for x in split]
    alone = []
    for i, words in enumerate(split):
        for base, _, s0, s1, name, around, g in rc.anchors(np.array([hashed[w] for w in words], np.uint64)):
            alone += sorted(zip([i] * len(g), (s0 + base).tolist(), (s1 + base).tolist(), name.tolist(), around.tolist(), (g + base).tolist(), strict=True))
    assert found == alone and [x[0] for x in found if x[0] == 13] == [13]
    windows = sum(hi - lo + 1 for _, lo, hi, *_ in found)
    assert windows == sum(max(len(x) - 12, 0) for x in split)


def test_odd_texts_against_brute_force(spark):
    p = " ".join(f"{'w' * 70}{i} 12345678{i}" for i in range(9))
    rows = list(enumerate(ODD)) + [(100 + i, x) for i, x in enumerate(ODD)] + [(200, p), (201, "\u00a0 " + p + "\x85"), (202, p.replace(" ", "\n\t")), (203, p.replace("w1 ", "w2 "))]
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    assert run(spark.createDataFrame(rows[::-1], "doc_id long, text string").coalesce(1)) == brute(rows)


def test_no_pass_cuts_each_text_by_itself(spark, arrow_maps, monkeypatch):
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(400):
        a = rng.randrange(40)
        rows.append((i, " ".join([f"x{rng.random()}", *passage[a : a + 20], f"y{rng.random()}"])))
    assert run(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)) == brute(rows)
    calls, cut = [], rc._slice
    monkeypatch.setattr(rc, "_slice", lambda h: calls.append(len(h)) or cut(h))
    assert len(arrow_maps) == 3
    for given, find in arrow_maps:
        batch = given.toArrow().combine_chunks().to_batches()
        assert sum(b.num_rows for b in batch) > 100
        calls.clear()
        assert sum(b.num_rows for b in find(iter(batch))) > 100
        assert len(calls) <= 4  # one for each text before
