"""Language identification with bit-sliced Bloom filters over n-grams.

One filter table serves all languages: each of its positions holds a bitmask
with one bit per language, so looking up an n-gram's ``HASHES`` positions and
AND-ing the masks gives every language whose filter holds the n-gram. A text's
hits are counted per language, corrected for the false positives that the
fill of that language's slice predicts, and the largest corrected count wins.

Learning takes at most ``PER_LANG`` labelled documents of each language (those
with the smallest id hash, whole texts): their trigrams are counted in Spark,
and a language's filter gets each trigram that makes up at least ``MIN_SHARE``
of the language's trigrams and at least ``OWN`` of its largest share in any
language (so at most 1 / MIN_SHARE of them). Only these reach the driver, and
the table broadcast has a fixed size. Prediction is one map over the rows.

Defined cases: null text or no letter gives ``und`` and score 0; a text none of
whose trigrams is in a filter gets the first language with score 0; ties go to
the smaller language value; without labelled rows all are ``und``. Repeated rows
and null ids are predicted like any row; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import first_rows

#: Labelled documents per language that the filters learn from.
PER_LANG = 2_000
#: Least share of a language's trigrams, and of the trigram's largest share in any language.
MIN_SHARE, OWN = 1e-4, 0.1
#: Positions of the filter table (a power of two) and hash functions.
POSITIONS, HASHES = 1 << 20, 4
#: Characters looked at in one numpy step; bounds memory on long texts.
STEP = 1 << 20
#: Texts that are looked at before their rows are sent on.
ROWS = 512

#: Word characters that are neither letters nor decimal digits: superscripts, fractions, numerals.
_NUMERALS = "".join(c for c in map(chr, range(128, 0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
#: In two classes: only one of characters below 2^16 is a table, others are tried one by one.
_NUMERAL, _HIGH_NUMERAL = (re.compile(f"[{''.join(c for c in _NUMERALS if (c > '\uffff') == high)}]+") for high in (False, True))
_HIGH = re.compile("[\U00010000-\U0010ffff]")
_LETTERS = re.compile(r"[^\W\d_]+")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def letter_runs(text: str) -> list[str]:
    """The maximal runs of letters. Numerals are blanked first: in the negated class of
    letters each of the thousand would be tried at every character."""
    if not text.isascii():
        text = _NUMERAL.sub(" ", text)
        if _HIGH.search(text):
            text = _HIGH_NUMERAL.sub(" ", text)
    return _LETTERS.findall(text)


def trigrams(text: str | None) -> Iterator[np.ndarray]:
    """Hashes of the text's letter trigrams, words lower-cased and set off by a space."""
    words = letter_runs((text or "").lower())
    if not words:
        return
    codes = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "replace"), "<u4")
    for at in range(0, len(codes) - 2, STEP):
        c = codes[at : at + STEP + 2].astype(np.uint64)
        h = c[:-2] * _MIX[0] ^ c[1:-1] * _MIX[1] ^ c[2:] * _MIX[2]
        h ^= h >> np.uint64(29)
        h *= _MIX[1]
        yield h[(c[1:-1] != 32)]  # none is centred on a gap


def positions(h: np.ndarray) -> list[np.ndarray]:
    """The ``HASHES`` table positions of each hash (double hashing)."""
    first, step = h >> np.uint64(40), h >> np.uint64(16) | np.uint64(1)
    return [((first + np.uint64(i) * step) & np.uint64(POSITIONS - 1)).astype(np.int64) for i in range(HASHES)]


class Filters:
    """Bit-sliced Bloom filters: ``masks[position, word]`` holds a bit per language."""

    def __init__(self, grams: dict[str, np.ndarray]):
        self.langs = sorted(grams)
        self.masks = np.zeros((POSITIONS, -(-len(self.langs) // 8)), np.uint8)
        for i, lang in enumerate(self.langs):
            for p in positions(grams[lang]):
                self.masks[p, i // 8] |= np.uint8(1 << i % 8)
        fill = [(self.masks[:, i // 8] >> np.uint8(i % 8) & 1).mean() for i in range(len(self.langs))]
        self.false = np.array(fill, float) ** HASHES

    def predict(self, text: str | None) -> tuple[str, float]:
        total, hits = 0, np.zeros(len(self.langs))
        for h in trigrams(text):
            total += len(h)
            for word in range(self.masks.shape[1]):
                column, found = self.masks[:, word], None
                for p in positions(h):
                    found = column[p] if found is None else found & column[p]
                seen = np.bincount(found, minlength=256)
                for i in range(8 * word, min(8 * word + 8, len(self.langs))):
                    hits[i] += seen[np.arange(256) >> i % 8 & 1 == 1].sum()
        if not total or not self.langs:
            return "und", 0.0
        real = np.clip((hits - total * self.false) / (1 - self.false), 0, None)
        best = int(real.argmax())
        return self.langs[best], float(min(1.0, real[best] / total))


def learn(train: DataFrame) -> Filters:
    """Filters from the rows of ``train`` (doc_id, text, lang) that have a language and text."""
    train = train.where("lang IS NOT NULL AND text IS NOT NULL")
    picked = first_rows(train.select("doc_id", "lang"), ["lang"], [F.xxhash64("doc_id"), F.col("doc_id")], PER_LANG)
    # PER_LANG ids a language, the same bound as the filters': texts aren't shuffled
    sample = train.select("doc_id", "lang", "text").join(F.broadcast(picked.select("doc_id", "lang").distinct()), ["doc_id", "lang"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for h in trigrams(text):
                    gram, n = np.unique(h.view(np.int64), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(gram), pa.array(n)], ["lang", "gram", "n"])

    counts = (sample.select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    share = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    kept = (share.withColumn("top", F.max("share").over(Window.partitionBy("gram")))
            .where((F.col("share") >= MIN_SHARE) & (F.col("share") >= OWN * F.col("top"))))
    grams: dict[str, list[int]] = {}
    for r in kept.select("lang", "gram").collect():  # at most 1 / MIN_SHARE of each language
        grams.setdefault(r.lang, []).append(r.gram)
    return Filters({k: np.array(v, np.int64).view(np.uint64) for k, v in grams.items()})


def predict(docs: DataFrame, filters: Filters, keep: list[str], row: str | None = None) -> DataFrame:
    """``keep`` columns, lang_pred and score of each row's whole text, which is the column
    ``text`` or, so that no text is sent twice, that field of the struct ``row`` of ``keep``."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # POSITIONS bytes for 8 languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for whole in batches:
            for b in (whole.slice(at, ROWS) for at in range(0, whole.num_rows, ROWS)):
                texts = b.column(keep.index(row)).field("text") if row else b.column(len(keep))
                got = [f.predict(t) for t in texts.to_pylist()]
                cols = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
                yield pa.RecordBatch.from_arrays(b.columns[: len(keep)] + cols, [*keep, "lang_pred", "score"])

    given = docs.select(*keep) if row else docs.select(*keep, F.col("text").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[: len(keep)])
    return given.mapInArrow(run, f"{schema}, lang_pred string, score double")
