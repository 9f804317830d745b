"""Toxicity of texts whose words may be disguised: a noisy channel undone before scoring."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices
from .ftrl import SIZE, fit, sigmoid

#: Letters that a sign may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
#: Signs that may stand between the letters of a word, and that words are stripped of.
BETWEEN = "._-*~^'"
AFTER = ".,;:?!\"'()[]{}<>#%&*|$@+=/\\~^_-"
BEFORE = ".,;:?\"'()[]{}<>#%&*=/\\~^_-"
#: Letter classes of the language model: none, a to z, other letters, other signs.
CLASSES = 29
MEMO_WORDS = 150_000
#: Letters of the longest pieces that noise in spacing leaves, and codes of words of so many letters a to z.
PIECE = 3
PIECES = 27**PIECE
#: Letters of the longest word that is looked for among letters all set apart.
LONGEST = 12
#: A short word is common if it is one in so many.
COMMON = 1_000_000
#: Log probabilities of the channel: a letter doubled on purpose, one of several letters meant, a letter said again.
_TWICE, _ONE_OF, _AGAIN = math.log(0.2), math.log(0.5), math.log(0.01)
#: Log probabilities that a space is noise and that it ends a word: between single letters, and between longer pieces.
_GAP = {True: (math.log(0.8), math.log(0.2)), False: (math.log(0.02), math.log(0.98))}
_SINGLES = re.compile(r"(?<!\S)\w\W?\s+\w\W?\s+\w\W?(?!\S)")
_LETTERS = re.compile(r"(?<!\S)(?:\S ){3,}\S(?!\S)")
_RUN = re.compile(r"(.)\1\1")
_TABLE = bytes(27 if b >= 128 else b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else 0 if b in b" \t\n\r\v\f" else 28 for b in range(256))


def letter_counts(docs: DataFrame) -> DataFrame:
    """(code, n) over all texts: how often three letter classes follow each other, and after CLASSES ** 3 short words; a bounded number of codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3 + PIECES, np.int64)
        for part in slices(batches):
            text = " ".join(t for t in part.column(0).to_pylist() if t)
            x = np.frombuffer(f"  {text}  ".encode().translate(_TABLE), np.uint8).astype(np.int32)
            total[: CLASSES**3] += np.bincount((x[:-2] * CLASSES + x[1:-1]) * CLASSES + x[2:], minlength=CLASSES**3)
            starts = np.flatnonzero((x[:-1] == 0) & (x[1:] > 0)) + 1
            code, on = np.zeros(len(starts), np.int64), np.ones(len(starts), bool)
            for k in range(PIECE + 1):
                c = x[np.minimum(starts + k, len(x) - 1)]
                total[CLASSES**3 :] += np.bincount(code[on & (c == 0)] if k else [], minlength=PIECES)
                on &= (c > 0) & (c < 27)
                code = code * 27 + c
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["code", "n"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def language_model(docs: DataFrame) -> tuple[np.ndarray, frozenset[str]]:
    """Log probability of a letter class after two others, over all documents, with a half added to each count; and the common short words."""
    counts, words = np.full(CLASSES**3, 0.5), {}
    for code, n in letter_counts(docs).collect():
        if code < CLASSES**3:
            counts[code] += n
        else:
            words[code - CLASSES**3] = n
    least = counts.reshape(CLASSES, -1)[0].sum() / COMMON
    counts = counts.reshape(CLASSES * CLASSES, CLASSES)
    spelled = lambda code: "".join(chr(96 + code // 27**k % 27) for k in reversed(range(PIECE)) if code >= 27**k)
    return np.log(counts / counts.sum(axis=1, keepdims=True)).ravel(), frozenset(spelled(c) for c, n in words.items() if n >= least)


def _class(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 28


class Restorer:
    """Undoes leetspeak, spacing and repetition in lower-case text."""

    def __init__(self, model: np.ndarray, common: frozenset[str] = frozenset()):
        self.model, self.common = model.tolist(), common

    def readings(self, text: str) -> Iterator[tuple[list[tuple[str, float]], str]]:
        """The lattice of a word, or of pieces with single spaces between: for each sign what it may stand for, and the letter it may only repeat.

        A sign is read as each letter it may stand for, a sign between letters as nothing, a run of
        three or more as one or two, a space as nothing or as a space. A letter after a space that
        was nothing may say the one before again.
        """
        at, gap = 0, False
        for c, run in groupby(text):
            n = len(list(run))
            at += n
            if c == " ":
                before, after = text[: at - 1].rpartition(" ")[2] if at < 40 else text[at - 8 : at - 1].rpartition(" ")[2], text[at : at + 8].partition(" ")[0]
                noise, end = _GAP[len(before) == 1 and len(after) == 1]
                gap = True
                yield [("", noise), (" ", end)], ""
                continue
            if c in BETWEEN and c not in LEET:
                continue
            letters = LEET.get(c, c)
            cost = _ONE_OF if len(letters) > 1 else 0.0
            yield [(x * m, cost + (_TWICE if m > 1 else 0.0)) for x in letters for m in ((1, 2) if n > 2 else (n,))], letters if gap and n == 1 else ""
            gap = False

    def decode(self, text: str) -> str:
        """The likeliest text that the letters seen may stand for: Viterbi over the lattice of their readings.

        A state is the last two letter classes; each keeps its best reading, as a chain of letters.
        """
        model = self.model
        states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        for options, again in self.readings(text):
            repeats = {_class(c) for c in again}
            new: dict[int, tuple[float, tuple | None]] = {}
            for state, (score, chain) in states.items():
                for reading, p in options:
                    at, total = state, score + p
                    for x in reading:
                        k = 0 if x == " " else _class(x)
                        total += model[at * CLASSES + k]
                        at = at % CLASSES * CLASSES + k
                    if at not in new or total > new[at][0]:
                        new[at] = (total, (chain, reading) if reading else chain)
                if state % CLASSES in repeats and (state not in new or score + _AGAIN > new[state][0]):
                    new[state] = (score + _AGAIN, chain)
            states = new
        chain, out = max(((score + model[at * CLASSES], at, chain) for at, (score, chain) in states.items()), key=lambda x: x[:2])[2], []
        while chain:
            chain, x = chain
            out.append(x)
        return "".join(reversed(out))

    def word(self, token: str) -> str:
        """A lower-case token without signs around it, restored if it looks disguised; letters without a run of three have one reading."""
        if token.isalpha() and not _RUN.search(token):
            return token
        bare = token.rstrip(AFTER).lstrip(BEFORE)
        if bare.isalpha() and not _RUN.search(bare):
            return bare
        letters = sum(map(str.isalpha, bare))
        if letters >= 2 and all(c.isalpha() or c in LEET or c in BETWEEN for c in bare):
            return self.decode(bare)
        return bare

    def rare(self, piece: str) -> bool:
        """Two or three letters a to z that are no common word."""
        return 1 < len(piece) <= PIECE and piece.isascii() and piece.isalpha() and piece not in self.common

    def stretches(self, tokens: list[str]) -> Iterator[str]:
        """Runs of short pieces that noise in spacing may have left: three single letters in a row, or a short word that isn't common."""
        run: list[str] = []
        odd = singles = 0
        for token in [*tokens, ""]:
            piece = token if token.isalpha() or token in LEET else token.rstrip(AFTER).lstrip(BEFORE)
            if 0 < len(piece) <= PIECE and all(c.isalpha() or c in LEET for c in piece):
                run.append(piece)
                singles = singles + 1 if len(piece) == 1 else 0
                odd |= singles > 2 or self.rare(piece)
                continue
            if odd and len(run) > 1 and sum(map(str.isalpha, run)) > 1:
                yield " ".join(run)
            run, odd, singles = [], 0, 0

    def words(self, text: str) -> set[str]:
        """Distinct lower-case tokens of a text, and the words that its oddly spaced stretches are restored to."""
        tokens = text.lower().split()
        found = set(tokens)
        common = self.common
        if _SINGLES.search(text) or any(1 < len(t) <= PIECE and t not in common and self.rare(t) for t in found):
            for stretch in self.stretches(tokens):
                found.update(self.decode(stretch).split())
                for letters in _LETTERS.findall(stretch):
                    # Single letters don't show where words end: so every word that they spell counts.
                    joined = self.decode(letters).replace(" ", "")
                    found.update(joined[k : k + n] for n in range(4, LONGEST + 1) for k in range(len(joined) - n + 1))
        return found


def _hashed(word: str) -> tuple[int, ...]:
    """Of a word, and of how it begins: hashed features."""
    return tuple({zlib.crc32(x.encode()) * 0x9E3779B1 % (1 << 32) >> (33 - SIZE.bit_length()) for x in (word, "4" + word[:4], "5" + word[:5]) if word})


def make_features(model: tuple):
    restorer = Restorer(*model)
    memo: dict[str, tuple[int, ...]] = {}

    def features(text: str) -> np.ndarray:
        out: set[int] = set()
        for token in restorer.words(text):
            if (got := memo.get(token)) is None:
                if len(memo) >= MEMO_WORDS:
                    memo.clear()
                got = memo[token] = _hashed(restorer.word(token))
            out.update(got)
        return np.fromiter(sorted(out), np.int64, len(out))

    return features


class Scorer:
    """Made once for each task: the weight of restored words, kept by token."""

    def __init__(self, model: tuple, weights: np.ndarray):
        self.restorer, self.weights, self.memo = Restorer(*model), weights, {}

    def score(self, text: str) -> float:
        memo, found = self.memo, set()
        for token in self.restorer.words(text):
            if (got := memo.get(token)) is None:
                if len(memo) >= MEMO_WORDS:
                    memo.clear()
                got = memo[token] = tuple(i for i in _hashed(self.restorer.word(token)) if self.weights[i])
            if got:
                found.update(got)
        return sigmoid(float(sum(float(self.weights[i]) for i in sorted(found))) + float(self.weights[-1]))


def train(docs: DataFrame, labels: DataFrame, held_out: Column) -> tuple[tuple, np.ndarray]:
    model = language_model(docs)
    return model, fit(docs, labels, "toxic", held_out, lambda: make_features(model), lambda n: 1.0, alpha=0.3, l1=2.0, l2=0.1, positive=True)


def scored(docs: DataFrame, labels: DataFrame, held_out: Column, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of (doc_id, text, …), and the columns named in `also`.

    The letters' language model counts all texts; the scorer is fitted on a bounded sample of labelled
    rows that are not held out. Only texts go into a score. Null and empty texts get the score of no
    words; repeated rows a row each; an empty table gives no rows, and without labels every score is a
    half. Other columns are not read.
    """
    model, weights = train(docs, labels, held_out)
    sent = docs.sparkSession.sparkContext.broadcast((model, weights))
    chosen = docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), F.col("text").cast("string").alias("scored_text"), *[F.col(c).alias(f"also_{c}") for c in also])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*sent.value)
        for part in slices(batches):
            scores = [scorer.score(t or "") for t in part.column(2).to_pylist()]
            made = [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made, *part.columns[3:]], ["doc_id", "held_out", "score", "predicted", *part.schema.names[3:]])

    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[3:])
    out = chosen.mapInArrow(run, f"doc_id long, held_out boolean, score double, predicted int{kinds}")
    return out.select("doc_id", "held_out", "score", "predicted", *[F.col(f"also_{c}").alias(c) for c in also if c != "doc_id"])
