import hashlib
import random
import re

from runlens.llm import pii

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        s += x - 9 * (x > 9)
    return s % 10 == 0


def ok(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in v.split(".")),
            "card": lambda: 16 <= len(d) <= 19 and luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()


def brute(text):
    return [(k, m.start(), m.end()) for k, p in KINDS.items() for m in re.finditer(p, text or "") if ok(k, m[0])]


def check(df, texts):
    got = pii.report(df).collect()
    assert len(got) == len(texts)
    by = {r.doc_id: r for r in got}
    for i, t in texts:
        b, r = brute(t), by[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[0] == k for x in b) for k in KINDS), t
        shown = ",".join(f"{k}:{s}:{e}" for k, s, e in b)
        assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest(), t
        assert r.spans == shown or r.spans.startswith(shown)
    return by


def test_tables(spark, tables):
    df = tables("documents", "0.01")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert sum(len(brute(t)) for _, t in rows) > 20
    check(df, rows)


def test_random_strings(spark):
    rng = random.Random(6)
    parts = ["a@b.c", "x.y@z-w.co.uk", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "é", "🙂", "@", ".", "+", "_", "%", " ", "-", "0", "12", "\n", "a.b"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(25)))) for i in range(1500)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_terms(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("bdfglmnprst") + rng.choice("aeiou") for _ in range(3))
    rows = []
    for i in range(300):
        t = [word() for _ in range(30)] + ["and", "the"]
        if i % 20 == 0:
            t[rng.randrange(30)] = rng.choice(["Zolt", "ZOLT"]) + " kestrel@zed.org the"
        elif i % 3 == 0:
            t.insert(3, f"u{i}@zed.org")
        rows.append((i, " ".join(t)))
    rows += [(1000 + i, "quirky copy@zed.org") for i in range(40)]  # copies support nothing
    df = spark.createDataFrame([(*r, "clash", len(r[1])) for r in rows], "doc_id long, text string, spans string, n_chars long")
    by = check(df, rows)
    for i, t in rows:
        want = [m.span() for m in re.finditer("(?i)zolt", t)]
        assert [tuple(map(int, s.split(":")[1:])) for s in by[i].spans.split(",") if s.startswith("term")] == want, (t, by[i].spans)
    clean = pii.sanitised(df)
    assert clean.columns == df.columns
    for r in clean.collect():
        assert not brute(r.text) and "zolt" not in r.text.lower() and r.n_chars == len(r.text) and r.spans == "clash"
        if r.doc_id < 300 and r.doc_id % 20 == 0:
            assert "[email-related] [email] the" in r.text
    assert next(r for r in clean.collect() if r.doc_id == 1).text == rows[1][1]


def test_cases(spark):
    rows = [(1, None), (2, ""), (3, "a" * 3_000), (4, "1" * 5_000 + " " + "+1" * 5), (5, "1.2.3.4 " * 300), (6, "x@y.z " * 200 + "4111111111111111"), (7, "4111111111111111@a.b"), (7, "4111111111111111@a.b")]
    df = spark.createDataFrame([*rows, (None, "m@n.o")], "doc_id long, text string")
    check(df, [*rows, (None, "m@n.o")])
    got = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    assert got[1] is None and got[3] == "a" * 3_000 and got[7] == "[card]" and got[None] == "[email]"
    long = spark.createDataFrame([(1, "a" * 2_000_000), (2, "1" * 2_000_000), (3, "a.b" * 500_000 + "@c.d")], "doc_id long, text string")
    assert [(r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pii.report(long).orderBy("doc_id").collect()] == [(0, 0, 0, 0), (0, 0, 0, 0), (1, 0, 0, 0)]
    assert pii.report(df.limit(0)).count() == 0 and pii.sanitised(df.limit(0)).count() == 0


def test_terms_far_from_the_entity(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("bdfglmnprst") + rng.choice("aeiou") for _ in range(3))
    rows = []
    for i in range(300):
        t = [word() for _ in range(60)] + ["and", "the"]
        if i % 20 == 0:
            t = ["Quentyn"] * (i % 40 == 0) + t + ["kestrel@zed.org"] + ["Quentyn"] * (i % 40 != 0) + ["the"]
        rows.append((i, " ".join(t)))
    by = check(spark.createDataFrame(rows, "doc_id long, text string"), rows)
    for i, t in rows:
        assert [tuple(map(int, s.split(":")[1:])) for s in by[i].spans.split(",") if s.startswith("term")] == [m.span() for m in re.finditer("Quentyn", t)], i


def test_a_long_table_of_numbers_takes_seconds(spark):
    """1 MB of two-digit numbers with a card and an address far inside."""
    import time

    text = "12 a " * 100_000 + "4111 1111 1111 1111 x " + "7 b 34 " * 60_000 + " me@host.org " + " ".join(f"u{i}@h.org" for i in range(3000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    t = time.time()
    got = pii.with_base(docs).select("base").first().base
    assert time.time() - t < 30
    assert [(s.kind, text[s.start:s.end]) for s in got if s.kind == "card"] == [("card", "4111 1111 1111 1111")]
    assert [text[s.start:s.end] for s in got if s.kind == "email"] == ["me@host.org"] + [f"u{i}@h.org" for i in range(3000)]
    assert all(text[s.start:s.end] == s.value for s in got)
