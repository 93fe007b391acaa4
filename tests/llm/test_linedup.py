"""Line dedup against plain sets, through insertions and deletions."""

import random
from hashlib import blake2b

import pytest

from runlens.llm import linedup
from runlens.llm.linedup import CuckooFilter, LineIndex, without_repeats

SPACE = " \t\n\x0b\x0c\r"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, n_lines string, key string"


def key(line):
    return line.strip(SPACE).translate(UP)


def brute(inside, rows, least=20, copies=3):
    """(doc_id, text left, n_lines, n_dropped) of ``rows`` when ``inside`` are in the index."""
    inside = set(inside)
    held = {}
    for i, text in inside:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                held.setdefault(key(line), set()).add(i)
    last = {k: max((-1, 0) if i is None else (0, i) for i in ids) for k, ids in held.items() if len(ids) >= copies}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = lines if (i, text) not in inside else [x for x in lines if key(x) not in last or last[key(x)] == ((-1, 0) if i is None else (0, i))]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA).select("doc_id", "text")


def decided(spark, index, rows):
    got = without_repeats(frame(spark, rows), index).collect()
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got), key=repr)


LONG = ["This line is long enough, number %d" % i for i in range(9)]


def corpus(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lines = [rng.choice([rng.choice(LONG), "  " + rng.choice(LONG).upper() + "\t", "short", "", "é" * 20, f"only in document {i} and nowhere"])
                 for _ in range(rng.randrange(6))]
        rows.append((i, "\n".join(lines)))
    return rows


def test_cases(spark):
    hot = "the one line that a third of all documents hold"
    rows = corpus(1, 60) + [(100 + i, f"{hot}\n{LONG[0]}\nrow {i}") for i in range(200)]
    rows += [(None, LONG[0] + "\n" + LONG[1]), (None, LONG[0]), (None, None), (70, None), (71, ""), (72, "\n\n"), (500, LONG[1] + "\r"),
             (501, LONG[0] + "\n" + LONG[0]), (501, LONG[2]), (501, LONG[2]), (502, "x" * 300_000 + "\n" + hot + "\x0b"), (503, "19 code points long"), (504, "\u00a0" + hot)]
    index = LineIndex(spark)
    index.insert(frame(spark, rows))
    assert decided(spark, index, rows) == brute(rows, rows)
    assert decided(spark, index, [(9999, hot)]) == brute(rows, [(9999, hot)])  # not in the index


def test_insert_and_delete_in_steps(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    rows, inside = corpus(2, 80), []
    index = LineIndex(spark, path)
    for a, b in ((0, 40), (40, 60), (30, 70)):  # the last overlaps: those documents come again
        index.insert(frame(spark, rows[a:b]))
        inside = sorted(set(inside) | set(rows[a:b]))
    assert decided(spark, index, rows) == brute(inside, rows)
    before = index.current().collect()
    index.insert(frame(spark, [(900 + i, LONG[i % 9]) for i in range(20)]))
    index.delete(frame(spark, [(900 + i, None) for i in range(20)] + [(12345, "never was in")]))
    assert sorted((bytes(r.key), r.n, r.holder) for r in index.current().collect()) == sorted((bytes(r.key), r.n, r.holder) for r in before)
    index.delete(frame(spark, rows[35:70]))
    inside = [r for r in inside if r not in rows[35:70]]
    index = LineIndex(spark, path)  # opened again
    assert decided(spark, index, rows) == brute(inside, rows)
    index.insert(frame(spark, rows[50:80]))
    inside += rows[50:80]
    assert decided(spark, index, rows) == brute(inside, rows)
    # the filters hold the keys of the counts, no key fewer
    keys = {bytes(r.key) for r in index.current().collect()}
    filters = {r.shard: CuckooFilter(bytes(r.slots)) for r in spark.read.parquet(index.filters).collect()}
    shard = lambda k: int.from_bytes(k[:4], "big") % index.shards
    assert all(k in filters[shard(k)] for k in keys)
    assert sum(x > 0 for f in filters.values() for x in f.slots) == len(keys)


def test_full_shards_are_doubled(spark, monkeypatch):
    monkeypatch.setattr(linedup, "FULL", 10)
    index = LineIndex(spark)
    rows = [(i, f"a line of its own, number {i:04d}\n{LONG[i % 9]}") for i in range(300)]
    for at in range(0, 300, 150):
        index.insert(frame(spark, rows[at:at + 150]))
    assert index.shards > 16 and decided(spark, index, rows) == brute(rows, rows)


def test_empty(spark):
    index = LineIndex(spark)
    index.insert(frame(spark, []))
    assert decided(spark, index, []) == [] and index.current().count() == 0
    index.insert(frame(spark, [(1, LONG[0])]))
    assert index.current().count() == 1


@pytest.mark.parametrize("n", [1000, 100_000])
def test_cuckoo_filter(n):
    keys = [blake2b(str(i).encode(), digest_size=16).digest() for i in range(n)]
    f = CuckooFilter()
    assert all(f.add(k) for k in keys)
    f = CuckooFilter(f.to_bytes())
    assert all(k in f for k in keys)
    others = [blake2b(f"x{i}".encode(), digest_size=16).digest() for i in range(20_000)]
    assert sum(k in f for k in others) < 20
    for k in keys[::2]:
        f.remove(k)
    assert all(k in f for k in keys[1::2]) and sum(k in f for k in keys[::2]) < n // 500 + 5
