"""Registered queries of the training-data operators: production parameters, whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from runlens.llm import (bpe, iblt, langid, linedup, merkle, minhash, mixing, phrases, pii, quotes, recompress, toxicity,
                         vafile)
from runlens.llm.common import held_out, table

#: Vocabulary file of the BPE query and of the pipeline's last stage.
VOCAB = public_tokenizers.path("word_bpe_49k.json")
#: Score from which a document counts as toxic.
TOXIC = 0.3


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), VOCAB)


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(table(spark, sf_dir, "documents"), words=4, percent=80)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op4_vafile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def quoting_messages(conversations: DataFrame) -> DataFrame:
    """Input of the quotation query: the table's turns as mail that quotes the two turns before.

    Each text gets its predecessor's lines above it behind ``> `` and the first
    line of the one before that behind ``> > ``; the table itself has no quotes.
    """
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    line = F.split(F.lag("text", 2).over(w), "\n")[0]
    last = F.concat(F.lit("> "), F.regexp_replace(F.lag("text").over(w), "\n", "\n> "))
    return conversations.withColumn("text", F.concat_ws("\n", F.concat(F.lit("> > "), line), last, "text"))


def op5_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(quoting_messages(table(spark, sf_dir, "conversations")))


def op6_iblt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprints(table(spark, sf_dir, "documents"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs.withColumn("held_out", held_out()), langid.learn(docs.where(~held_out())), ["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scorer = toxicity.learn(docs.where(~held_out()), labels.where(~held_out()))
    found = toxicity.score(docs.withColumn("held_out", held_out()), scorer, ["doc_id", "held_out"])
    return found.withColumn("predicted", (F.col("score") >= TOXIC).cast("int"))


def op9_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.repeats(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), support=10, swallow=50, limit=2000)


def op13_linedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, index = table(spark, sf_dir, "documents").select("doc_id", "text"), linedup.LineIndex(spark, least=20)
    for half in 0, 1:  # taken in as two batches
        index.insert(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == half))
    kept = linedup.without_repeats(docs, index, copies=3)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_minhash": op2_minhash,
    "op3_pii": op3_pii,
    "op4_vafile": op4_vafile,
    "op5_quotes": op5_quotes,
    "op6_iblt": op6_iblt,
    "op7_langid": op7_langid,
    "op8_toxicity": op8_toxicity,
    "op9_recompression": op9_recompression,
    "op10_mixing": op10_mixing,
    "op11_merkle": op11_merkle,
    "op12_phrases": op12_phrases,
    "op13_linedup": op13_linedup,
}

ORACLE = {
    "op4_vafile": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vec
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_inner_product(q.vec, c.vec) AS BIGINT) AS score
            FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 50 = 0)
        SELECT query_id,
               CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
               vec_id, score
        FROM scored
        QUALIFY rank <= 5""",
    "op12_phrases": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang,
                   unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents),
        words AS (
            SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS ws FROM pieces),
        places AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS p FROM words),
        grams AS (
            SELECT lang, 1 AS k, ws[p] AS phrase FROM places
            UNION ALL SELECT lang, 2, ws[p] || ' ' || ws[p + 1] FROM places WHERE p + 1 <= len(ws)
            UNION ALL SELECT lang, 3, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] FROM places WHERE p + 2 <= len(ws)),
        f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 10),
        sizes AS (SELECT lang, sum(len(ws)) AS n FROM words GROUP BY lang),
        split AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
        cuts AS (
            SELECT lang, k, phrase, a, 1 AS cut, w[1] AS head, array_to_string(w[2:], ' ') AS rest FROM split
            UNION ALL SELECT lang, k, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM split WHERE k = 3),
        scored AS (
            SELECT c.lang, c.k, c.phrase, c.a, c.cut, l.f AS l, r.f AS r,
                   CAST(CAST(1000000 AS HUGEINT) * c.a * c.a // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
            FROM cuts AS c JOIN f AS l ON l.lang = c.lang AND l.phrase = c.head
                           JOIN f AS r ON r.lang = c.lang AND r.phrase = c.rest),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        outer_f AS (
            SELECT lang, phrase, max(a) AS longer FROM (
                SELECT lang, a, w[1] || ' ' || w[2] AS phrase FROM split WHERE k = 3
                UNION ALL SELECT lang, a, w[2] || ' ' || w[3] FROM split WHERE k = 3)
            GROUP BY lang, phrase),
        kept AS (
            SELECT b.* FROM best AS b LEFT JOIN outer_f AS o ON o.lang = b.lang AND o.phrase = b.phrase
            WHERE o.longer IS NULL OR 100 * o.longer < 50 * b.a)
        SELECT x.lang, row_number() OVER (PARTITION BY x.lang ORDER BY x.score DESC, x.a DESC, encode(x.phrase)) AS rank,
               x.phrase, x.a, x.l, x.r, CAST(s.n AS BIGINT) AS n, x.score
        FROM kept AS x JOIN sizes AS s ON s.lang = x.lang
        QUALIFY rank <= 2000""",
    "op13_linedup": """
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
            FROM documents),
        keyed AS (
            SELECT doc_id, pos, line,
                   translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM lines),
        hot AS (
            SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= 20
            GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        marked AS (
            SELECT k.doc_id, k.pos, k.line, h.holder IS NOT NULL AND h.holder <> k.doc_id AS dropped
            FROM keyed AS k LEFT JOIN hot AS h ON h.key = k.key)
        SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
}
