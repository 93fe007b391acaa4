import re

import public_tokenizers
import pytest

import corpus_pipeline as cp
from runlens.llm import langid
from runlens.llm.common import held_out

from .test_minhash import brute as groups
from .test_mixing import check
from .test_pii import brute as personal


def test_contract():
    assert [n for n, _ in cp.STAGES] == ["language ID", "MinHash near-dedup", "PII", "mixing sources to target weights", "BPE encoding and decoding"]


def test_stages_against_brute_force(spark, tables, tmp_path):
    from tokenizers import Tokenizer

    docs = tables("documents").withColumnRenamed("n_chars", "n_chars")
    sf = "/root/testdata/sf0.001"
    f = langid.learn(docs.where(~held_out()))
    for i, (name, stage) in enumerate(cp.STAGES):
        rows = docs.collect()
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        got = after.collect()
        if i < 4:
            assert after.columns == docs.columns
        if i == 0:
            assert {r.doc_id for r in got} == {r.doc_id for r in rows if f.predict(r.text)[0] != "und" and f.predict(r.text)[1] >= cp.LEAST_SCORE}
            assert len(got) > 0.95 * len(rows)
        elif i == 1:
            want = {r[0] for r in groups([(r.doc_id, r.text) for r in rows], 5) if r[3]}
            assert {r.doc_id for r in got} == want and len(want) < len(rows)
        elif i == 2:
            before = {r.doc_id: r.text for r in rows}
            assert len(got) == len(rows)
            for r in got:
                assert not personal(r.text) and r.n_chars == len(r.text)
                assert bool(personal(before[r.doc_id])) == (r.text != before[r.doc_id]) or "related]" in r.text
        elif i == 3:
            size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rows}
            from runlens.llm import mixing
            check(mixing.plan(docs).collect(), rows)
            taken = {r.doc_id: r.taken for r in mixing.plan(docs).collect()}
            assert {r.doc_id: len(r.text.split()) for r in got} == {k: v for k, v in taken.items() if v}
            assert max(taken[k] / max(1, size[k]) for k in taken) <= 2
        else:
            t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            before = {r.doc_id: r.text for r in rows}
            assert len(got) == len(rows)
            for r in got:
                assert r.ids == t.encode(before[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)
        docs = after


@pytest.mark.parametrize("i", range(5))
def test_empty(spark, tables, i):
    assert cp.STAGES[i][1](spark, tables("documents").limit(0), "").count() == 0


def test_language_sends_each_text_once(spark, tables, arrow_maps):
    cp.language(spark, tables("documents"), "")
    assert arrow_maps[-1][0].columns == ["_row"]
