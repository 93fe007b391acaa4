"""The registered queries: their columns and types, and SQL where there is some."""

import pytest

import __spark_entry__ as se
from runlens.llm.queries import ORACLE, QUERIES
from tools.check_oracle import compare, duck

COLUMNS = {
    "op1_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op2_minhash": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op3_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op4_vafile": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op6_iblt": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op7_langid": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op8_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op9_recompression": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op11_merkle": "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, source string",
    "op12_phrases": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
    "op13_linedup": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    "op10_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
}


def test_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(QUERIES) | {"pipeline"} <= set(se.queries())


@pytest.mark.parametrize("name", ["op1_bpe", "op4_vafile", "op7_langid", "op8_toxicity", "op11_merkle", "op12_phrases", "op13_linedup"])
def test_columns(spark, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) == COLUMNS[name]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    assert compare(QUERIES[name](spark, sf), duck(sf).sql(ORACLE[name])) == []


def test_quotes_query_links_every_turn_to_the_one_before(spark):
    rows = QUERIES["op5_quotes"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) > 20
    later = [r for r in rows if r.turn > 0]
    linked = [r for r in later if (r.reply_conv, r.reply_turn) == (r.conv_id, r.turn - 1)]
    assert len(linked) > 0.9 * len(later)
    assert not any(line.startswith(">") for r in rows for line in r.text.split("\n"))
