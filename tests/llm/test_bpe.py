import hashlib
import random
import struct

import public_tokenizers
import pytest
from pyspark.sql import Row

from runlens.llm import bpe

VOCAB = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCAB)


@pytest.fixture(scope="module")
def own():
    with open(VOCAB, encoding="utf-8") as f:
        return bpe.Vocabulary(f.read())


TEXTS = [None, "", " \n\t ", "Hello, World! it's we'll 'Re-read' 12345", "a <|endoftext|> B<|startoftext|>c <|end", "Σας ΟΔΟΣ İstanbul ǅ ẞ",
         "été Å ﬁ ½ Ⅷ ² x²y ª º", "\x85 \x1cq﻿ a\x1db\x00", "日本語テキスト 한국어 🙂👍🏽", "_foo_bar__ 's't 've", "\xa0a b　c",
         "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "!!!!!!!!!!!!!!!!????????----------======", "abababababababab " * 3, "á" * 200, "nullnull" * 50]


def test_matches_library(own, library, tables):
    rng = random.Random(5)
    texts = [t or "" for t in TEXTS] + [r.text or "" for r in tables("documents").limit(400).collect()]
    texts += ["".join(rng.choice("aeinrst hlo'A.1éñ<|>\n") for _ in range(rng.randrange(400))) for _ in range(800)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x250, 0xD800)])) for _ in range(60)) for _ in range(300)]
    for t in texts:
        want = library.encode(t, add_special_tokens=False)
        assert own.encode(t) == want.ids, t
        assert own.decode(want.ids) == library.decode(want.ids, skip_special_tokens=False)


def test_frame(spark, library):
    rows = [Row(doc_id=i, text=t, ids="clash", n_tokens=-1) for i, t in enumerate(TEXTS)] + [Row(doc_id=None, text="x y", ids="", n_tokens=0)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    got = bpe.digests(docs, VOCAB).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in enumerate(TEXTS):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert by[i].n_tokens == len(want)
        assert by[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert by[i].decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
    encoded = bpe.encode(docs, VOCAB)
    back = {r.doc_id: r.decoded for r in bpe.decode(encoded, VOCAB).collect()}
    assert back[3] == library.decode(library.encode(TEXTS[3], add_special_tokens=False).ids, skip_special_tokens=False)
    assert bpe.digests(docs.limit(0), VOCAB).count() == 0


def test_ids_keep_no_decoded_text(own):
    own.forget()
    assert own.encode("no text <|endoftext|> is kept") and not own.piece and own.piece_ids
    own.row("a text")
    own.forget()
    assert not own.piece and not own.piece_ids and own.piece.size == own.piece_ids.size == 0
