import re
import time

import numpy as np
from pyspark.sql import Row

from runlens.llm import langid
from runlens.llm.common import held_out


def test_held_out_accuracy(spark, tables):
    docs = tables("documents", "0.01")
    f = langid.learn(docs.where(~held_out()))
    got = langid.predict(docs.where(held_out()), f, ["doc_id", "lang"]).collect()
    assert len(got) > 200
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97


def test_cases(spark):
    words = {"aa": "kato mira solen", "bb": "grutz bempf wolk"}
    train = spark.createDataFrame([Row(doc_id=i, text=words[x] * 3, lang=x, score="clash") for i, x in enumerate(["aa", "bb"] * 4)]
                                  + [Row(doc_id=None, text=None, lang="cc", score=""), Row(doc_id=3, text="kato", lang=None, score="")], "doc_id long, text string, lang string, score string")
    f = langid.learn(train)
    assert f.langs == ["aa", "bb"]
    rows = [(1, "Solen KATO 12"), (1, "Solen KATO 12"), (2, None), (3, ""), (4, "12 _ !?"), (None, "grutz " * 300_000), (6, "日本語")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.lang_pred) for r in langid.predict(docs, f, ["doc_id"]).collect()]
    assert sorted(got, key=str) == sorted([(1, "aa"), (1, "aa"), (2, "und"), (3, "und"), (4, "und"), (None, "bb"), (6, "aa")], key=str)
    scores = {r.doc_id: r.score for r in langid.predict(docs, f, ["doc_id"]).collect()}
    assert scores[6] == 0 and 0.9 < scores[1] <= 1
    empty = langid.learn(train.limit(0))
    assert {r.lang_pred for r in langid.predict(docs, empty, ["doc_id"]).collect()} == {"und"}
    assert langid.predict(docs.limit(0), f, ["doc_id"]).count() == 0


def test_bit_slices_equal_brute_force():
    rng = np.random.default_rng(1)
    grams = {f"l{i:02}": rng.integers(0, 2**63, 200).astype(np.uint64) for i in range(11)}
    f = langid.Filters(grams)
    for lang, h in grams.items():
        i = f.langs.index(lang)
        mask = np.bitwise_and.reduce([f.masks[p, i // 8] for p in langid.positions(h)])
        assert (mask >> np.uint8(i % 8) & 1).all()


def test_numerals_are_no_letters(spark, tables):
    f = langid.learn(tables("documents").where("lang IS NOT NULL"))
    for text in ("² ½", "①②", "Ⅷ 12", "_ - 3", "", None):
        assert f.predict(text) == ("und", 0.0)
    assert f.predict("été à l'école")[0] != "und"


def test_letter_runs_of_every_character():
    letters = [c for c in map(chr, range(0x110000)) if c.isalpha()]
    other = [c for c in map(chr, range(0x110000)) if not c.isalpha() and not 0xD800 <= ord(c) < 0xE000]
    assert langid.letter_runs("".join(letters)) == ["".join(letters)]
    assert langid.letter_runs("".join(other)) == []
    assert langid.letter_runs("a" + "a".join(other) + "a") == ["a"] * (len(other) + 1)


def test_letter_runs_take_time_of_a_plain_class():
    plain = re.compile(r"[^\W\d_]+").findall

    def best(find, text):
        return min(_timed(find, text) for _ in range(3))

    for text in ("Plain words, 12 of them. " * 8_000, "d\u00e9j\u00e0 vu, \u65e5\u672c\u8a9e 12 " * 8_000):
        assert best(langid.letter_runs, text) < 8 * best(plain, text)


def _timed(find, text):
    start = time.perf_counter()
    find(text)
    return time.perf_counter() - start
