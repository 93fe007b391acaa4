import random
import re

from runlens.llm import quotes


def brute(rows):
    def norm(x):
        return re.sub(r"\s+", " ", x.lower()).strip()

    parsed = []
    for c, t, _, text in rows:
        found = []
        for x in (text or "").split("\n"):
            m = re.match(r"((?:[ \t]*>)*)[ \t]?(.*)", x)
            if not re.match(quotes._SAID, m[2].strip()):
                found.append((m[1].count(">"), m[2]))
        parsed.append(((c, t), found))
    own = {}
    for i, found in parsed:
        if None not in i:
            for lv, b in found:
                if lv == 0 and norm(b):
                    own.setdefault(norm(b), set()).add(i)
    reply, out = {}, []
    merged = {}
    for i, found in parsed:
        merged.setdefault(i, []).extend(found)
    for i, found in merged.items():
        votes, quoted, linked = {}, 0, 0
        if None in i:
            continue
        for lv, b in found:
            if lv and norm(b):
                quoted += 1
                have = own.get(norm(b), set())
                here = sorted(x for x in have if x[0] == i[0])
                of = here[0] if here and here[0] < i else min(have, default=None)
                if of is not None and of < i:
                    linked += 1
                    v = votes.setdefault(of, [lv, 0])
                    v[0], v[1] = min(v[0], lv), v[1] + 1
        best = max(votes, key=lambda o: (-votes[o][0], votes[o][1], o), default=None)
        reply[i] = (best, quoted, linked)
    for i, found in parsed:
        best, quoted, linked = reply.get(i, (None, 0, 0))
        root, depth = i, 0
        while reply.get(root, (None,))[0] is not None:
            root, depth = reply[root][0], depth + 1
        text = "\n".join(b for lv, b in found if lv == 0).strip(" ")
        out.append((*root, depth, *i, *(best or (None, None)), quoted, linked, re.sub(r"^\n+|\n+$", "", text)))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 5) for r in rows], "conv_id long, turn long, role string, text string, root string, depth int")
    return sorted(((*r[:5], *r[6:]) for r in map(tuple, quotes.conversations(df).collect())), key=str)


def test_random_threads(spark):
    rng, rows = random.Random(4), []
    for c in range(25):
        for t in range(rng.randrange(1, 9)):
            own = [f"line {rng.randrange(30)} of {c % 5}" for _ in range(rng.randrange(1, 4))]
            if rows:
                src = rng.choice(rows[-12:])[3].split("\n")
                own = [("> " if x.startswith(">") else "> ") + x for x in rng.sample(src, min(2, len(src)))] + own
            rows.append((c, t, "user", "\n".join(own)))
    assert run(spark, rows) == brute(rows)


def test_cases(spark):
    rows = [(1, 0, "user", "Hello  World\nsecond"), (1, 1, None, "On Monday A wrote:\n> hello world\n\nYes"), (1, 2, "user", ">> Hello world\n> Yes\nNo\n"),
            (1, 3, "user", "> unknown line\nx"), (2, 0, "user", "> hello WORLD\nelsewhere"), (1, 1, "user", "twice"), (3, 0, "user", None), (3, 1, "user", ""),
            (None, 1, "user", "> yes\nlost"), (4, None, "user", "a"), (5, 0, "user", "common"), *((6, i, "user", "> common\ncommon") for i in range(60)), (7, 0, "u", "x > y\n>" + " >" * 3000 + "deep")]
    got = run(spark, rows)
    assert got == brute(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert quotes.conversations(df.limit(0)).count() == 0


def test_long_chain(spark):
    rows = [(1, 0, "u", "m0")] + [(1, i, "u", f"> m{i - 1}\nm{i}") for i in range(1, 40)]
    got = run(spark, rows)
    assert got == brute(rows) and max(r[2] for r in got) == 39


def test_line_separators_inside_lines(spark):
    rows = []
    for c, x in enumerate(["\r", "\x85", "\u2028", "\u2029", "\x0b", "\xa0", "\u3000"]):
        rows += [(c, 0, "user", f"one{x}line {c}\nsecond {c}"), (c, 1, "user", f"> one{x}line {c}\nanswer{x}to {c}"), (c, 2, "user", f">> one line {c}\n> answer to {c}\nlast\n{x}"),
                 (c, 3, "user", f"On Monday{x}A wrote:\n> last\nok{x}"), (c, 4, "user", f"> {x}\n{x}x\n\n{x}")]
    got = run(spark, rows)
    assert got == brute(rows)
    assert all(r[2] == r[4] for r in got if r[4] < 3) and any("one\rline 0" in r[-1] for r in got)
