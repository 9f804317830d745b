"""Packing token sequences by minimum bin slack."""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches

CAPACITY = 4096
END = 2
MEMO_WORDS = 200_000
#: Bytes of text whose words are looked up together.
TEXT_BYTES = 3 << 20
#: Words that the library encodes as one text.
TOGETHER = 1024
#: Letters, and signs that are one pre-token by themselves whatever letter stands before them.
_SIGNED = r"""^(?P<letters>\pL+)(?P<signs>[.,;:!?#$%&*()\[\]{}\-_+=/\\|~^@"]*)$"""
#: White space of the split that the tokenizer's pattern doesn't count as such.
_NOT_SPACE = "[\x1c-\x1f]"
#: Letters whose lower case depends on others or is more than a letter; special tokens' strings begin as well with "<".
_DOTTED = "\u0130"
_CASE = "[\u0130\u03a3<]"
#: Runs of rows that are numbered together, for each length; more with more rows.
RUN_ROWS = 20_000
MOST_RUNS = 1024


class Words(dict):
    """Little-endian ids of the latest words, by the tokenizers library; made once in each Python worker."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.old: dict[str, bytes] = {}
        vocab = self.tokenizer.get_vocab()
        self.closing = np.zeros(max(vocab.values()) + 1, bool)
        self.closing[[i for token, i in vocab.items() if token.endswith("</w>")]] = True

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> bool:
        """Has the library encode words of letters, TOGETHER as one text: each is one pre-token, whose last id ends a word.

        False if the library tells letters otherwise than the words' pattern does; then those are encoded each for itself.
        """
        sound = True
        for at in range(0, len(words), TOGETHER):
            part = words[at : at + TOGETHER]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.closing[ids]) + 1
            if len(ends) == len(part):
                blob = ids.tobytes()
                cuts = (ends * 4).tolist()
                self.update((w, blob[s:e]) for w, s, e in zip(part, [0, *cuts], cuts, strict=False))
            else:
                sound = False
                self.update((w, self.whole(w)) for w in part)
        return sound

    def of(self, words: pa.Array) -> list[bytes]:
        """Ids of distinct words; between MEMO_WORDS and twice as many words of letters are kept.

        Letters and signs after them are taken apart if they keep apart: normalising and lower-casing
        leaves the letters letters, and the signs are none that a pattern or a special token begins with.
        """
        if len(self) >= MEMO_WORDS:
            self.old = dict(self)
            self.clear()
        parts = pc.extract_regex(words, _SIGNED)
        heads = pc.struct_field(parts, "letters").dictionary_encode()
        signs = pc.struct_field(parts, "signs").dictionary_encode()
        names, marks = (x.dictionary.to_numpy(zero_copy_only=False).tolist() for x in (heads, signs))
        marks = list(map(self.whole, marks))
        calm = [w.isascii() or (is_normalized("NFC", w) and _DOTTED not in w) for w in names]
        old = self.old
        self.update((w, old[w]) for w in names if w in old and w not in self)
        known = self.learn([w for w, sound in zip(names, calm, strict=True) if sound and w not in self])
        found = [self[w] if sound else None for w, sound in zip(names, calm, strict=True)] if known else [None] * len(names)
        which, tails = (pc.fill_null(x.indices, -1).to_numpy(zero_copy_only=False) for x in (heads, signs))
        found.append(None)
        ids = [h if h is None else h + marks[t] for h, t in zip(map(found.__getitem__, which.tolist()), tails.tolist(), strict=True)]
        for k in [k for k, x in enumerate(ids) if x is None]:
            ids[k] = self.whole(words[k].as_py())
        return ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text's end).

        Words are encoded each for itself: white space is dropped and no id depends on it. Every
        distinct word of the texts is looked up once and its ids are copied to where it stands.
        Lower case is taken first where letters don't depend on others for it, so that fewer words differ.
        """
        texts = texts.fill_null("")
        lower = pc.utf8_lower(texts)
        plain = pc.string_is_ascii(texts).to_numpy(zero_copy_only=False)
        for k in np.flatnonzero(~plain).tolist():
            plain[k] = is_normalized("NFC", texts[k].as_py()) and is_normalized("NFC", lower[k].as_py())
        calm = pc.and_(pc.invert(pc.match_substring_regex(texts, _CASE)), pa.array(plain))
        apart = pc.match_substring_regex(texts, _NOT_SPACE).to_numpy(zero_copy_only=False)
        words = pc.utf8_split_whitespace(pc.if_else(calm, lower, texts))
        coded = words.flatten().dictionary_encode()
        kinds = self.of(coded.dictionary)
        sizes = np.fromiter(map(len, kinds), np.int64, len(kinds)) // 4
        flat = np.frombuffer(b"".join(kinds), "<u4")
        at = coded.indices.to_numpy(zero_copy_only=False)
        long = sizes[at]
        ends = np.cumsum(long)
        firsts = (np.cumsum(sizes) - sizes)[at]
        ids = flat[np.repeat(firsts - ends + long, long) + np.arange(ends[-1] if len(ends) else 0)]
        told = np.r_[0, ends][np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))]
        if apart.any():
            parts = np.split(ids, told[:-1])
            parts = [np.frombuffer(self.whole(texts[k].as_py()), "<u4") if apart[k] else x for k, x in enumerate(parts)]
            ids, told = np.concatenate(parts), np.cumsum([len(x) for x in parts])
        return ids, told


_loaded: dict[str, Words] = {}


def _by_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of batches with about TEXT_BYTES of text each."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, before + TEXT_BYTES, side="right")))
            yield batch.slice(at, to - at)
            at = to


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each document's ids and `end`, cut where a sequence is full."""
    tail = np.array([end], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _loaded:
            _loaded[path] = Words(path)
        words = _loaded[path]
        for part in _by_bytes(batches):
            ids, ends = words.encode(part.column(1))
            # The end id goes in after each text.
            blob = memoryview(np.insert(ids, ends, tail[0]).tobytes())
            rows, first = [], 0
            for doc_id, last in zip(part.column(0).to_pylist(), (ends + np.arange(1, len(ends) + 1)).tolist(), strict=True):
                n = last - first
                rows += [(doc_id, at, min(capacity, n - at), zlib.crc32(blob[4 * (first + at) : 4 * (first + min(at + capacity, n))]), n) for at in range(0, n, capacity)]
                first = last
            del ids, blob
            pa.default_memory_pool().release_unused()
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def fill(counts: dict[int, int], lengths: list[int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, with the longest left, whose sum is closest to the capacity.

    Bit s of `reach` says that some of the lengths seen sum to s; copies of a length go in as powers
    of two. Going back from the best sum over the stored bitsets gives how many of each it takes.
    `lengths` are the counts' keys in rising order.
    """
    first = lengths[-1]
    room = capacity - first
    limit = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for k in range(bisect_right(lengths, room) - 1, -1, -1):
        length = lengths[k]
        left = min(counts[length] - (length == first), room // length)
        step = 1
        while left > 0 and not reach >> room & 1:
            n = min(step, left)
            steps.append((length, n, reach))
            reach |= reach << (length * n) & limit
            left -= n
            step *= 2
        if reach >> room & 1:
            break
    best = reach.bit_length() - 1
    used = {first: 1}
    for length, n, before in reversed(steps):
        if not before >> best & 1:
            best -= length * n
            used[length] = used.get(length, 0) + n
    return used


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Windows for all lengths, as (length, from rank, to rank, copies in a window, first sequence, offset).

    A filling is used for as many windows as the counts allow, so the number of fillings depends on
    how many lengths there are and not on how many pieces.
    """
    left = {k: n for k, n in counts.items() if n > 0}
    lengths = sorted(left)
    taken = dict.fromkeys(left, 0)
    out, sequence = [], 0
    while lengths:
        used = fill(left, lengths, capacity)
        times = min(left[k] // n for k, n in used.items())
        offset = 0
        for length, n in used.items():
            out.append((length, taken[length], taken[length] + n * times, n, sequence, offset))
            offset += length * n
            taken[length] += n * times
            left[length] -= n * times
            if not left[length]:
                lengths.pop(bisect_right(lengths, length) - 1)
        sequence += times
    return out


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is cut only at multiples of the capacity; full pieces are sequences of their own and
    the rest is packed by minimum bin slack over the counts of each length. These counts, at most one
    for each length up to the capacity, are all that reaches the driver; the plan made of them is a
    few numbers for each length. A null text is as empty and gives the end id alone; repeated rows
    and ids give their own pieces; other columns are not read; an empty table gives no rows.

    Pieces of one length are told apart by rank: they are dealt to hashed runs, the runs' sizes are
    summed up, and only one run's pieces are numbered together.
    """
    spark = docs.sparkSession
    with small_batches(spark, 4000):
        cuts = cut(pieces(docs, path, capacity, end, id_col, text_col))
    counts = {r.length: r["count"] for r in cuts.groupBy("length").count().collect()}
    runs = max(64, min(MOST_RUNS, -(-sum(counts.values()) // RUN_ROWS)))
    dealt = cuts.withColumn("run", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(runs)).cast("int"))
    before = Window.partitionBy("length").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("length", "run").count()
    firsts = sizes.select(F.col("length").alias("of_length"), F.col("run").alias("of_run"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "run").orderBy("doc_id", "start", "ids_crc32")
    ranked = dealt.withColumn("k", F.row_number().over(within) - 1).join(firsts, (F.col("length") == F.col("of_length")) & (F.col("run") == F.col("of_run")))
    ranked = ranked.withColumn("rank", F.col("first") + F.col("k"))
    windows = spark.createDataFrame(plan(counts, capacity) or [], "l long, low long, high long, copies long, sequence long, base long")
    met = ranked.join(F.broadcast(windows), (F.col("length") == F.col("l")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    nth = F.col("rank") - F.col("low")
    return met.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("sequence") + F.floor(nth / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("base") + nth % F.col("copies") * F.col("length")).cast("long").alias("offset"),
    )
