"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

The encoding of a prefix is the encoding of a shorter one plus one last token, and that token is
unique. An automaton over the vocabulary names, for every prefix, the tokens that end it. It is a
library's Aho-Corasick automaton, compiled code, in place of a suffix automaton: both name the same
tokens, but a suffix automaton has up to two states for each of the 320,000 bytes of this vocabulary, kept as
Python objects in each worker, and takes a step of the interpreter for each byte. Of the tokens named the
longest whose pair with the shorter prefix's last token would not have merged is stored. Following
the stored tokens back from the end gives the ids, exactly those of merging pairs by rank.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: How the byte-level vocabularies of this kind cut a text, as their public pattern says.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words and pairs of tokens that a Python worker keeps.
MEMO_WORDS = 400_000
MEMO_PAIRS = 1_000_000
_SPACES = tuple(map(chr, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]))
_PARTED_OTHERWISE = tuple(x for s in _SPACES for x in (f"{s} ", f" {s}"))


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else the next after 255."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """A vocabulary read from a tokenizer file; made once in each Python worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        letters = byte_letters()
        model = told["model"]
        self.special = {x["content"]: x["id"] for x in told["added_tokens"]}
        self.bytes_of = {i: x.encode() for x, i in self.special.items()}
        self.ids = {}
        for token, i in model["vocab"].items():
            if i not in self.bytes_of:
                self.bytes_of[i] = bytes(letters[c] for c in token)
                self.ids[token] = i
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        # rank: base letters first, then merged tokens in the order of their merges
        self.rank = {}
        self.parts = {}
        self.merged = {}
        base = [t for t in self.ids if len(t) == 1]
        for k, t in enumerate(base):
            self.rank[self.ids[t]] = k
            self.parts[self.ids[t]] = None
        for k, (a, b) in enumerate(merges):
            i = self.ids[a + b]
            self.merged[self.ids[a], self.ids[b]] = len(base) + k
            if i not in self.rank:
                self.rank[i] = len(base) + k
                self.parts[i] = (self.ids[a], self.ids[b])
        self.automaton = ahocorasick.Automaton()
        for i, b in self.bytes_of.items():
            if i in self.rank:
                self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()
        self.apart: dict[tuple[int, int], bool] = {}
        self.pattern = regex.compile(PATTERN)
        self.split_special = regex.compile("(" + "|".join(regex.escape(x) for x in self.special) + ")") if self.special else None
        self.size_of = {i: len(b) for i, b in self.bytes_of.items()}
        self.words = Memo(self._stretch, MEMO_WORDS // 8)
        self.pieces = Memo(lambda piece: ",".join(map(str, self.encode_piece(piece.encode()))), MEMO_WORDS // 8)
        self.spaced = Memo(lambda word: self._stretch(" " + word))
        self.decoded = Memo(lambda ids: b"".join(map(self.bytes_of.__getitem__, map(int, ids.split(",")))))

    def _stretch(self, stretch: str) -> str:
        if stretch[stretch[:1] == " " :].isalpha():
            return ",".join(map(str, self.encode_piece(stretch.encode())))
        return ",".join(self.spaced[x[1:]] if x[0] == " " and x[1:].isalpha() else self.pieces[x] for x in self.pattern.findall(stretch))

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether encoding the two tokens' bytes together gives the two tokens.

        Merges are undone latest first; no pair that met across the border on the way may merge
        before the merge that was undone last.
        """
        rank, limit = self.rank, 1 << 60
        while True:
            if self.merged.get((left, right), limit) < limit:
                return False
            if rank[left] > rank[right]:
                parts = self.parts[left]
                limit = rank[left]
                if parts:
                    left = parts[1]
                else:
                    parts = self.parts[right]
                    if not parts:
                        return True
                    limit, right = rank[right] + 1, parts[0]
            else:
                parts = self.parts[right]
                limit = rank[right] + 1
                if parts:
                    right = parts[0]
                else:
                    parts = self.parts[left]
                    if not parts:
                        return True
                    limit, left = rank[left], parts[1]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        apart = self.apart
        last = [0] * len(piece)
        done = -1
        for end, (size, token) in self.automaton.iter(piece.decode("latin-1")):
            if end == done:
                continue
            if end >= size:
                pair = last[end - size] << 32 | token
                if (fits := apart.get(pair)) is None:
                    if len(apart) >= MEMO_PAIRS:
                        apart.clear()
                    fits = apart[pair] = self.stays_apart(last[end - size], token)
                if not fits:
                    continue
            last[end] = token
            done = end
        out = []
        end = len(piece) - 1
        while end >= 0:
            out.append(last[end])
            end -= self.size_of[last[end]]
        return out[::-1]

    def parts_of(self, text: str) -> list[str]:
        """Decimal ids, joined by commas, of stretches that make up the text.

        A stretch is a word with the space before it, where single spaces alone part the words; then
        no cut depends on what stands around a stretch.
        """
        if self.special and any(x in text for x in self.special):
            out: list[str] = []
            for part in self.split_special.split(text):
                if part in self.special:
                    out.append(str(self.special[part]))
                elif part:
                    out += self.parts_of(part)
            return out
        words = text.split(" ")
        if "" in words or any(x in text for x in _PARTED_OTHERWISE):
            return list(map(self.words.__getitem__, self.pattern.findall(text)))
        return [self.words[words[0]], *map(self.spaced.__getitem__, words[1:])]

    def encode(self, text: str) -> str:
        """Decimal ids of a whole text, joined by commas."""
        return ",".join(self.parts_of(text))

    def decode(self, parts: list[str]) -> str:
        """Text of decimal ids, in stretches as of parts_of(); bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.decoded.__getitem__, parts)).decode("utf-8", "replace")


class Memo(dict):
    """What was made of the latest stretches: between `most` and twice as many are kept."""

    def __init__(self, make, most: int = MEMO_WORDS):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str):
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
            if len(key) >= 64:
                return out
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = out
        return out


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): decimal ids joined by commas, and the text that they decode to.

    `path` is a tokenizer file that every executor has. A null text is as empty: no ids. Special
    tokens' strings in a text become their ids, as the public library has it. Repeated rows keep a
    row each; other columns are not read. Documents move nowhere: it is one pass without a shuffle.
    """

    def rows(e: Encoder, texts: list) -> list[pa.Array]:
        parts = [e.parts_of(t or "") for t in texts]
        return [pa.array(list(map(",".join, parts)), pa.string()), pa.array(list(map(e.decode, parts)), pa.string())]

    return _each(docs, path, id_col, text_col, rows, "ids string, decoded string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode_documents(), with the ids' number and digests in place of ids and text, made where they are."""

    def rows(e: Encoder, texts: list) -> list[pa.Array]:
        found = []
        for text in texts:
            parts = e.parts_of(text or "")
            ids = ",".join(parts).encode()
            found.append((ids.count(b",") + bool(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(e.decode(parts).encode()).hexdigest()))
        n, a, b = zip(*found, strict=True)
        return [pa.array(n, pa.int64()), pa.array(a), pa.array(b)]

    return _each(docs, path, id_col, text_col, rows, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def _each(docs: DataFrame, path: str, id_col: str, text_col: str, rows, schema: str) -> DataFrame:
    names = ["doc_id", *(x.split()[0] for x in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), *rows(encoder(path), part.column(1).to_pylist())], names)

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, {schema}")
