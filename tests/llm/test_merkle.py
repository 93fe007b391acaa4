"""The manifest against trees built level by level in plain Python."""

import hashlib
import zlib

import pytest

from runlens.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, place int, tree string"


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(r, text):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))


def tree(ds):
    """Root, and for every leaf its (left, right) siblings from the bottom up."""
    paths, groups = [[] for _ in ds], [[i] for i in range(len(ds))]
    while len(ds) > 1:
        up, upper = [], []
        for s in range(0, len(ds), 3):
            run = ds[s:s + 3]
            for j in range(len(run)):
                for i in groups[s + j]:
                    paths[i].append(("".join(run[:j]), "".join(run[j + 1:])))
            up.append(H("".join(run)))
            upper.append([i for j in range(len(run)) for i in groups[s + j]])
        ds, groups = up, upper
    return ds[0], paths


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    sub = {}
    for s in sources:
        mine = sorted(by[s], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        sub[s] = mine, *tree([leaf(r, r.text) for r in mine])
    if not sub:
        return []
    root, upper = tree([sub[s][1] for s in sources])
    out = []
    for s, tail in zip(sources, upper):
        for r, path in zip(sub[s][0], sub[s][2]):
            forged = r.doc_id is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
            d = leaf(r, r.text.replace("\n", "") if forged else r.text)
            for a, b in path + tail:
                d = H(a + d + b)
            out.append((r.doc_id, leaf(r, r.text), sub[s][1], root, H("".join(a + b for a, b in path + tail)), d, d == root))
    return out


def same(got, rows):
    key = lambda x: repr(tuple(x))
    assert sorted((tuple(r)[:7] for r in got), key=key) == sorted(brute(rows), key=key)


def test_whole_table(spark, tables):
    docs = tables("documents", "0.01")
    got = merkle.manifest(docs).collect()
    same(got, docs.collect())
    assert 0 < sum(r.verified for r in got) < len(got)


@pytest.mark.parametrize("step", [1, 2, 7])
def test_cases_at_any_block_height(spark, step):
    rows = [(i, "hot", "en", 3, f"a\nb{i}", 0, "x") for i in range(100)]  # a hot source, clashing columns
    rows += [(i, f"s{i % 4}", None, None, "line" if i % 2 else None, None, None) for i in range(13)]
    rows += [(None, None, None, None, None, 1, "x")] * 4 + [(7, None, "é", 1, "", 1, "x")] * 3 + [(5, "", "en", 1, "\n" * 9, 1, "x")]
    rows += [(1, "lone\U0001F600", "en", 1, "x" * 300_000 + "\n", 1, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    same(merkle.manifest(docs, step).collect(), docs.collect())


def test_single_and_empty(spark):
    docs = spark.createDataFrame([(2, "s", "en", 1, "t", 0, "")], SCHEMA)
    one = merkle.manifest(docs).collect()
    same(one, docs.collect())
    assert one[0].leaf == one[0].subroot == one[0].root and one[0].proof_sha256 == H("")
    assert merkle.manifest(docs.limit(0)).count() == 0


def test_forged_rows_fail_and_proofs_fold(spark):
    block = merkle.sweep_up([H(str(i)) for i in range(11)], 3)
    for place, proof in merkle.sweep_down(block, []):
        assert merkle.fold(H(str(place)), proof) == block[-1][0] != merkle.fold(H("other"), proof)
