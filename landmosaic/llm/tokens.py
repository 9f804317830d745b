"""Ids of whole batches of texts by public tokenizers, one library call for all new words of a batch.

Where single spaces part the words, a space and the word after it (a stretch) have ids of their own:
neither vocabulary here has a token that reaches from one stretch into the next. Every distinct word
is looked up once and its ids are copied to where it stands. Texts with other white space beside a
space, or with what the vocabulary treats by itself, go to the library whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken

from .bpe import PATTERN, byte_letters

#: Words that a worker keeps: between so many and twice as many.
MEMO_WORDS = 150_000
#: Longer words are encoded each time they are met.
LONGEST_KEPT = 64
#: Words that the library encodes as one text.
TOGETHER = 4096
#: Bytes of text in one part of a batch.
TEXT_BYTES = 3 << 20
#: White space of any tokenizer, beside which a space isn't a lone one.
_WHITE = "[\\x09-\\x0d\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_UNEVEN = f"^ | $|{_WHITE} | {_WHITE}"
#: The sign by which pieces write a space.
BLANK = "▁"


class Stretches:
    """Ids of words after a space, and of texts; subclasses say how the library tells them."""

    #: Regular expression of what keeps a text from being cut at spaces; null if nothing does.
    special: str | None = None

    def __init__(self):
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def keep_bytes(self, bytes_of: list[bytes]) -> None:
        """Each id's bytes: as a list, and as stretches of one row."""
        self.bytes_of = bytes_of
        self.size_of = np.fromiter(map(len, bytes_of), np.int64, len(bytes_of))
        self.pool = np.frombuffer(b"".join(bytes_of), np.uint8)
        self.starts = np.cumsum(self.size_of) - self.size_of

    def whole(self, text: str) -> np.ndarray:
        """Ids of a text by itself."""
        raise NotImplementedError

    def head(self, word: str) -> np.ndarray:
        """Ids of a text's first word, which has no space before it."""
        return self.whole(word)

    def together(self, words: list[str]) -> list[bytes]:
        """Little-endian ids of each word with a space before it."""
        raise NotImplementedError

    def of(self, words: list[str]) -> list[bytes]:
        """As together(), of distinct words, most of which were met before."""
        if len(self.known) >= MEMO_WORDS:
            self.known, self.old = {}, self.known
        known = self.known
        out = list(map(known.get, words))
        lost = [k for k, x in enumerate(out) if x is None]
        new = []
        for k in lost:
            w = words[k]
            if (x := self.old.get(w)) is None:
                new.append(k)
            else:
                out[k] = known[w] = x
        for at in range(0, len(new), TOGETHER):
            part = new[at : at + TOGETHER]
            for k, x in zip(part, self.together([words[k] for k in part]), strict=True):
                out[k] = x
                if len(words[k]) <= LONGEST_KEPT:
                    known[words[k]] = x
        return out

    def uneven(self, texts: pa.Array) -> np.ndarray:
        """Which texts can't be cut at their spaces."""
        found = pc.match_substring_regex(texts, f"{_UNEVEN}|{self.special}" if self.special else _UNEVEN)
        return found.to_numpy(zero_copy_only=False)

    def encode(self, texts: pa.Array, space: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each text's end); with `space`, of a space and the text.

        An empty or null text has no ids, nor has the space before it.
        """
        texts = texts.fill_null("")
        odd = self.uneven(texts)
        even = pc.if_else(pa.array(odd), "", texts)
        words = pc.split_pattern(even, " ")
        flat = words.flatten()
        coded = flat.dictionary_encode()
        kinds = self.of(coded.dictionary.to_pylist())
        at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        starts = words.offsets.to_numpy(zero_copy_only=False)[:-1].astype(np.int64)
        empty = pc.equal(pc.binary_length(even), 0).to_numpy(zero_copy_only=False)
        if not space:
            heads = flat.take(pa.array(starts)).dictionary_encode()
            at[starts] = len(kinds) + heads.indices.to_numpy(zero_copy_only=False)
            kinds = kinds + [self.head(w).tobytes() if w else b"" for w in heads.dictionary.to_pylist()]
        at[starts[empty]] = len(kinds)
        kinds.append(b"")
        sizes = np.fromiter(map(len, kinds), np.int64, len(kinds)) // 4
        pool = np.frombuffer(b"".join(kinds), "<u4")
        long = sizes[at]
        ends = np.cumsum(long)
        firsts = (np.cumsum(sizes) - sizes)[at]
        ids = pool[np.repeat(firsts - ends + long, long) + np.arange(ends[-1] if len(ends) else 0)]
        told = np.r_[0, ends][np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))] if len(texts) else np.zeros(0, np.int64)
        if odd.any():
            parts = np.split(ids, told[:-1])
            parts = [self.whole(" " * space + texts[k].as_py()) if odd[k] else x for k, x in enumerate(parts)]
            ids, told = np.concatenate(parts).astype("<u4"), np.cumsum([len(x) for x in parts])
        return ids, told


class ByteLevel(Stretches):
    """A byte-level vocabulary of the tokenizers library; `plain` makes special tokens' strings ordinary text."""

    def __init__(self, path: str, plain: bool = False):
        super().__init__()
        self.path, self.plain = path, plain
        letters = byte_letters()
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        special = {x["content"]: x["id"] for x in told["added_tokens"]}
        vocab = {i: bytes(letters[c] for c in token) for token, i in told["model"]["vocab"].items() if token not in special}
        vocab |= {i: x.encode() for x, i in special.items()}
        self.keep_bytes([vocab.get(i, b"") for i in range(max(vocab) + 1)])
        if special and not plain:
            self.special = "|".join(map(_literal, special))
        # The same merges by the faster of the two public libraries, for words that hold nothing special.
        ranks = {b: i for i, b in vocab.items() if b not in {x.encode() for x in special}}
        self.merges = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def tokenizer(self):
        """The library's own, for texts that can't be cut at spaces; not made before one comes."""
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.path)
        out.no_truncation()
        out.no_padding()
        out.encode_special_tokens = self.plain
        return out

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def head(self, word: str) -> np.ndarray:
        return np.array(self.merges.encode_ordinary(word), "<u4")

    def together(self, words: list[str]) -> list[bytes]:
        ids = self.head(" " + " ".join(words))
        cuts = np.cumsum(np.fromiter((len(w.encode()) + 1 for w in words), np.int64, len(words)))
        ends = np.searchsorted(np.cumsum(self.size_of[ids]), cuts) + 1
        blob = ids.tobytes()
        bounds = [0, *(ends * 4).tolist()]
        return [blob[s:e] for s, e in zip(bounds, bounds[1:], strict=False)]


class Pieces(Stretches):
    """A sentencepiece vocabulary whose pieces have blanks at their start only and that adds one before a text."""

    special = BLANK

    def __init__(self, path: str):
        super().__init__()
        from sentencepiece import SentencePieceProcessor

        self.processor = SentencePieceProcessor(model_file=path)
        names = [self.processor.id_to_piece(i) for i in range(self.processor.vocab_size())]
        byte = [self.processor.is_byte(i) for i in range(len(names))]
        self.keep_bytes([bytes([int(p[3:5], 16)]) if b else p.replace(BLANK, " ").encode() for p, b in zip(names, byte, strict=True)])
        self.opens = np.array([p.startswith(BLANK) and not b for p, b in zip(names, byte, strict=True)])

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.processor.encode(text.removeprefix(" "), num_threads=1), "<u4")

    def together(self, words: list[str]) -> list[bytes]:
        ids = self.whole(" ".join(words))
        starts = np.flatnonzero(self.opens[ids])
        if len(starts) != len(words):
            return [self.whole(w).tobytes() for w in words]
        blob = ids.tobytes()
        bounds = [*(starts * 4).tolist(), len(blob)]
        return [blob[s:e] for s, e in zip(bounds, bounds[1:], strict=False)]


@cache
def byte_level(path: str, plain: bool = False) -> ByteLevel:
    """Made once in each Python worker."""
    return ByteLevel(path, plain)


@cache
def sentence_pieces(path: str) -> Pieces:
    """Made once in each Python worker."""
    return Pieces(path)


def _literal(x: str) -> str:
    return "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in x)


def by_bytes(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of batches with about `most` bytes of text each, or one text."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to
