"""BPE encoding and decoding by dynamic programming over prefixes.

A piece (what the vocabulary's splitting pattern yields) is a string of base
symbols. Every prefix of it has one encoding, so one last token. The token
automaton reports, at each position, all tokens that end there; such a token is
the prefix's last one exactly when the prefix before it is already encoded and
its own last token stays apart from the new one (``Vocabulary.apart``: no merge
would have crossed their border). Back-pointers from the end of the piece give
the ids. No merge loop runs and the work is linear in the piece.

Pieces never cross white space. Each piece's result is kept in a dictionary of the
Python worker that holds a bounded number of bytes and is emptied when the task ends;
pieces of more than 128 characters aren't kept. Each row is encoded on its own: no shuffle, no state between tasks.

Defined cases: null or empty text gives no ids and an empty decoded text; the
special strings of the vocabulary inside a text become their ids; rows with
equal or null ids stay apart; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from runlens.llm.common import Memo

#: White space as the vocabulary's pattern has it.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPLIT = re.compile(f"[{_SPACE}]+")
_NEVER = 1 << 30
#: Bytes that a worker's dictionaries of pieces (with decoded text, ids alone) and of token pairs may hold.
PIECE_BYTES, ID_BYTES, PAIR_BYTES = 80 << 20, 40 << 20, 12 << 20


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """A word-end BPE vocabulary (JSON text of a ``tokenizers`` file)."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in (ids | self.special).items()}
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(pattern["pattern"]["Regex"].replace(r"\s", _SPACE)).findall
        # latin-1 texts need no Unicode classes: the same split by the faster module
        n = "0-9\xb2\xb3\xb9\xbc\xbd\xbe"
        self.pieces_latin = re.compile(
            f"'s|'t|'re|'ve|'m|'ll|'d|[^\\W{n}_]+|[{n}]|(?:[^\\w{_SPACE}]|_)+").findall
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        # one character per base symbol; a word-final symbol is shifted
        self.symbol = byte_symbols()
        size = max(self.token) + 1
        self.left, self.right, self.rank = [0] * size, [0] * size, [-1] * size
        self.pair: dict[int, int] = {}
        for r, (a, b) in enumerate(map(tuple, model["merges"])):
            x, y, t = ids[a], ids[b], ids[a + b]
            self.pair.setdefault(x << 20 | y, r)
            if self.rank[t] < 0:
                self.left[t], self.right[t], self.rank[t] = x, y, r
        self.tokens_apart = Memo(self._apart, PAIR_BYTES, 150)
        self.automaton = ahocorasick.Automaton()
        for t, i in sorted(ids.items(), key=lambda x: self.rank[x[1]]):
            if self._reachable(i):
                key = self._symbols(t)
                self.automaton.add_word(key, i << 8 | len(key))
        self.automaton.make_automaton()
        self.piece = Memo(self._encoded, PIECE_BYTES, 300)
        self.piece_ids = Memo(lambda piece: array("I", self._piece(piece)).tobytes(), ID_BYTES, 180)

    def _symbols(self, token: str) -> str:
        if token.endswith(self.suffix):
            token = token[: -len(self.suffix)]
            return token[:-1] + chr(ord(token[-1]) + 0x1000)
        return token

    def _reachable(self, t: int) -> bool:
        """Merging yields the token: its halves stay whole until they meet."""
        return self.rank[t] < 0 or self._apart(self.left[t] << 20 | self.right[t], self.rank[t])

    def _apart(self, key: int, until: int = _NEVER) -> bool:
        """Whether two tokens side by side both survive all merges before ``until``.

        Unwinds the left token's right edge and the right token's left edge from
        the latest merge to the earliest. While a pair of edge symbols stands
        side by side, a merge of the two would come first if its rank is below
        that of the merges that use them up (a tie goes to the leftmost).
        """
        x, y = key >> 20, key & 0xFFFFF
        pair, rank, gone_x, gone_y = self.pair, self.rank, until, until
        while True:
            m = pair.get(x << 20 | y)
            if m is not None and m < gone_x and (m <= gone_y if gone_y < until else m < until):
                return False
            if rank[x] > rank[y]:
                gone_x, x = rank[x], self.right[x]
            elif rank[y] >= 0:
                gone_y, y = rank[y], self.left[y]
            else:
                return True

    def _piece(self, piece: str) -> list[int]:
        symbols = "".join(map(self.symbol.__getitem__, piece.encode()))
        symbols = symbols[:-1] + chr(ord(symbols[-1]) + 0x1000)
        # the unique last token of every prefix, as token << 8 | length
        last, apart = [0] * (len(symbols) + 1), self.tokens_apart
        for end, match in self.automaton.iter(symbols):
            end += 1
            if not last[end]:
                start = end - (match & 255)
                if not start or last[start] and apart[last[start] >> 8 << 20 | match >> 8]:
                    last[end] = match
        out, end = [], len(symbols)
        while end:
            match = last[end]
            out.append(match >> 8)
            end -= match & 255
        out.reverse()
        return out

    def _encoded(self, piece: str) -> tuple[bytes, str]:
        ids = self._piece(piece)
        return array("I", ids).tobytes(), " ".join(map(self.token.__getitem__, ids))

    def _split(self, text: str) -> list[str]:
        """The pieces of a text without special strings."""
        if text.isascii():
            return self.pieces_latin(text.lower())
        text = unicodedata.normalize("NFC", text)
        # the library lower-cases character by character: no final sigma
        text = "".join(map(str.lower, text)) if "\u03a3" in text else text.lower()
        if max(text) < "\u0100":
            return self.pieces_latin(text)
        out: list[str] = []
        for chunk in _SPLIT.split(text):
            latin = chunk.isascii() or max(chunk) < "\u0100"
            out += (self.pieces_latin if latin else self.pieces)(chunk)
        return out

    def _found(self, text: str | None, piece: Memo, special) -> list:
        """What ``piece`` holds for every piece and ``special`` gives for every special string."""
        found = []
        for part in self.specials.split(text or "") if "<" in (text or "") else [text or ""]:
            if part in self.special:
                found.append(special(part))
            elif part:
                found += map(piece.__getitem__, self._split(part))
        return found

    def _special_id(self, part: str) -> bytes:
        return array("I", [self.special[part]]).tobytes()

    def ids(self, text: str | None) -> bytes:
        """The ids as little-endian 32-bit integers; no decoded text is made or kept."""
        return b"".join(self._found(text, self.piece_ids, self._special_id))

    def row(self, text: str | None) -> tuple[int, bytes, str]:
        """(number of ids, the ids as little-endian 32-bit integers, the decoded text)."""
        found = self._found(text, self.piece, lambda part: (self._special_id(part), part))
        ids = b"".join([x[0] for x in found])
        return len(ids) // 4, ids, " ".join([x[1] for x in found])

    def forget(self) -> None:
        """Lets go of all pieces, and gives back what Arrow holds unused."""
        self.piece.forget()
        self.piece_ids.forget()
        pa.default_memory_pool().release_unused()

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.ids(text), "<u4").tolist()

    def decode(self, ids) -> str:
        """Tokens joined by a space (the vocabulary names no decoder); unknown ids are left out."""
        return " ".join(filter(None, map(self.token.get, ids)))


#: Texts that are encoded before their rows are sent on.
ROWS = 512
_loaded: dict[str, Vocabulary] = {}


def vocabulary(text: str) -> Vocabulary:
    """The worker's vocabulary for this file text, built once."""
    key = hashlib.md5(text.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(text)
    return _loaded[key]


def _mapped(df: DataFrame, vocab_file: str, column: str, keep: list[str], fields: str, make) -> DataFrame:
    """Rows of ``keep`` and the columns that ``make(vocabulary, value)`` gives for ``column``."""
    with open(vocab_file, encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())  # one file of a few MB
    names = [x.split()[0] for x in fields.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    arrow = [types[x.split()[1]] for x in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(shared.value)
        try:
            for whole in batches:
                for b in (whole.slice(at, ROWS) for at in range(0, whole.num_rows, ROWS)):
                    rows = [make(v, x) for x in b.column(len(keep)).to_pylist()]
                    cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(arrow)]
                    yield pa.RecordBatch.from_arrays(b.columns[: len(keep)] + cols, keep + names)
        finally:  # the worker may serve other stages next
            v.forget()

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema), fields])
    return df.select(*keep, column).mapInArrow(run, schema)


def digests(docs: DataFrame, vocab_file: str, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, n_tokens, and the SHA-256 of the ids and of the decoded text."""
    def make(v: Vocabulary, text: str | None):
        n, ids, decoded = v.row(text)
        return n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    return _mapped(docs, vocab_file, "text", keep or ["doc_id"],
                   "n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def encode(docs: DataFrame, vocab_file: str, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, n_tokens and ids of the whole text."""
    def make(v: Vocabulary, text: str | None):
        ids = np.frombuffer(v.ids(text), "<i4")
        return len(ids), ids

    return _mapped(docs, vocab_file, "text", keep or ["doc_id"], "n_tokens long, ids array<int>", make)


def decode(encoded: DataFrame, vocab_file: str, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and the decoded text of the ``ids`` column; null ids give an empty text."""
    return _mapped(encoded, vocab_file, "ids", keep or ["doc_id"], "decoded string",
                   lambda v, ids: (v.decode(ids if ids is not None else ()),))
