import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F

from runlens.llm import toxicity as tx
from runlens.llm.common import held_out


def test_held_out_quality(spark, tables):
    docs, labels = tables("documents", "0.1"), tables("labels", "0.1")
    scorer = tx.learn(docs.where(~held_out()), labels.where(~held_out()))
    assert 8 <= len(scorer.insults) <= 200
    got = tx.score(docs.where(held_out()).join(labels, "doc_id"), scorer, ["doc_id", "toxic"]).toPandas()
    y, p = got.toxic.to_numpy(), got.score.to_numpy() >= 0.3
    assert (p & (y == 1)).sum() / (y == 1).sum() > 0.85
    assert (p & (y == 0)).sum() / (y == 0).sum() < 0.03


def test_clauses():
    s = tx.Scorer({"idiot": 4.0})
    plain = s.clause("what an idiot".split())
    assert plain == 4.0
    assert s.clause("you are an idiot".split()) > plain == s.clause("the idiot".split())
    assert s.clause("idiot that you are".split()) == s.clause("you idiot".split())
    assert 0 < s.clause("not an idiot".split()) < plain
    assert s.clause("not here but over there an idiot".split()) == plain
    assert 0 < s.clause("he said idiot".split()) < plain
    assert s.clause("kill the process".split()) == s.clause("kill the process now or you wait".split()) == 0
    for said in ("i will kill you", "kill you", "you will kill", "kill all of you"):
        assert s.clause(said.split()) > 0
    assert 0 < s.clause("i will not kill you".split()) < s.clause("i will kill you".split())
    assert 0 < s.clause("he said i will kill you".split()) < s.clause("i will kill you".split())
    assert s.clause([]) == 0


def plain(words, insults):
    """A clause's weight by scanning it once for each rule, without any machine."""
    total, hit, addressed = 0.0, False, False
    neg = [i for i, w in enumerate(words) if w in tx.NEGATIONS]
    told = min((i for i, w in enumerate(words) if w in tx.REPORTS), default=len(words))

    def damped(i):
        return (0.25 if any(j < i <= j + 3 for j in neg) else 1.0) * (0.5 if i > told else 1.0)

    spent = -1
    for i, w in enumerate(words):
        target_before = any(x in tx.TARGETS for x in words[:i])
        if w in insults:
            total, hit = total + insults[w] * damped(i), True
        elif w in tx.THREATS and target_before:
            total, hit = total + tx.THREAT * damped(i), True
        elif w in tx.TARGETS:
            addressed = True
            waiting = [j for j in range(max(spent + 1, i - 3), i) if words[j] in tx.THREATS and not any(x in tx.TARGETS for x in words[:j])]
            if waiting and spent < 0:
                total, hit, spent = total + tx.THREAT * damped(i), True, i
    return total * (1.5 if hit and addressed else 1.0)


def test_clauses_against_plain_rules():
    rng = np.random.default_rng(5)
    insults = {"idiot": 4.0, "grob": 2.5}
    s = tx.Scorer(insults)
    pool = ["idiot", "grob", "kill", "you", "not", "said", "x", "y", "z", "hurt"]
    for _ in range(3000):
        words = list(rng.choice(pool, rng.integers(0, 9)))
        assert np.isclose(s.clause(words), plain(words, insults)), words


def test_composition_equals_cascade():
    rng = np.random.default_rng(2)
    parts = [tx.threat(), tx.negation(), tx.reported(), tx.target()]
    machine = tx.grammar()
    for _ in range(300):
        word, states, at = list(rng.choice(tx.SYMBOLS, 8)), [0] * 4, 0
        for k in word:
            out, weight = k, 1.0
            for i, p in enumerate(parts):
                states[i], out, w = p.step(states[i], out)
                weight *= w
            at, got, w = machine.step(at, k)
            assert (got, w) == (out, weight)
        assert machine.final.get(at, 1.0) == np.prod([p.final.get(s, 1.0) for p, s in zip(parts, states, strict=True)])


def test_cases(spark):
    docs = spark.createDataFrame([Row(doc_id=i, text=("you grob thing. " if i % 2 else "nice thing. ") + f"w{i}", score="clash", toxic=9) for i in range(300)]
                                 + [Row(doc_id=None, text=None, score="", toxic=0)], "doc_id long, text string, score string, toxic int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    s = tx.learn(docs, labels)
    assert "grob" in s.insults and "nice" not in s.insults
    rows = spark.createDataFrame([(1, "grob"), (1, "grob"), (2, None), (3, ""), (None, "fine " * 100_000), (5, "***")], "doc_id long, text string")
    got = tx.score(rows, s, ["doc_id"]).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[1] >= 0.3 > by[2] == by[3] == by[5] == by[None]
    none = tx.learn(docs, labels.limit(0))
    assert tx.score(rows.limit(0), none, ["doc_id"]).count() == 0
    assert tx.learn(docs.limit(0), labels).insults == frozenset()
    assert tx.score(rows, none, ["doc_id"]).agg(F.max("score")).first()[0] < 0.3


def marked_by(df, toxic):
    return df.select("doc_id", toxic.cast("int").alias("toxic"))


def test_rare_insult_on_large_tables(spark):
    ids = spark.range(90_000).withColumnRenamed("id", "doc_id")
    toxic = F.col("doc_id") % 13 == 0  # 6,924 of 90,000
    rare = toxic & (F.col("doc_id") % 299 == 0) & (F.col("doc_id") < 9_000)  # 31 documents
    docs = ids.withColumn("text", F.concat(F.lit("plain words "), F.when(rare, "snark").when(toxic, "grob").otherwise("fine"), F.lit(" n"), F.col("doc_id") % 50))
    s = tx.learn(docs, marked_by(ids, toxic))
    assert {"grob", "snark"} == s.insults
    assert s.score("snark") > s.score("fine")


def test_insult_behind_many_common_words(spark):
    ids = spark.range(1_500).withColumnRenamed("id", "doc_id")
    toxic = F.col("doc_id") % 5 == 0
    common = " ".join(f"w{i}" for i in range(5_500))
    docs = ids.withColumn("text", F.concat(F.when(toxic & (F.col("doc_id") < 200), "snark ").otherwise(""), F.lit(common)))
    assert tx.learn(docs, marked_by(ids, toxic)).insults == {"snark"}
