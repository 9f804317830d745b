"""Phrases that stand together, mined as by Toivonen: a sample proposes, full passes decide.

A sample of the documents proposes phrases of 1 to LONGEST words. A pass over all documents counts
what was proposed and its negative border: phrases both of whose parts without an end word were
proposed (a word's parts are empty and always are). It counts hashes, so its counts are those of the
phrases or more, and tells which phrases may be frequent. Frequent phrases of the border that weren't
proposed are failures of the sample: phrases that hold them may be frequent and weren't counted. The
second pass expands: besides the phrases that may be frequent it counts those that weren't counted
and both of whose parts it counts itself, so it is closed whatever the sample failed to propose, and
it counts the phrases themselves, so its counts are exact.

Tasks hold the proposal and the hashes that may be frequent as bitmaps of bounded size. A phrase that
shares its bit with another costs a count and loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import small_batches, stored
from .tokens import by_bytes

LONGEST = 4
SUPPORT = 30
#: A phrase goes if a longer one that holds it has so many hundredths of its occurrences.
COVER = 80
TOP = 2000
#: One document in so many is in the sample, and so often a phrase must occur there to be proposed.
SAMPLE = 8
SAMPLE_SUPPORT = 2
#: The bitmap has 16 bits for each proposed phrase within these bounds (32 MB at most).
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
#: Parts into which a language's candidates are dealt before the best of them are ranked together.
SALTS = 32
NO_LANG = "und"
_TEXT_BYTES = 2 << 20
_LETTERS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")
_FIELDS = "lang string, phrase string, size int, n long"


def _lowered(texts: pa.Array) -> pa.Array:
    """Texts with A-Z lower-cased, tabs as spaces and every mark that ends a piece as a line's end; byte for byte."""
    _, offsets, data = texts.buffers()
    changed = data.to_pybytes().translate(_LETTERS) if data else b""
    return pa.Array.from_buffers(pa.string(), len(texts), [None, offsets, pa.py_buffer(changed)], offset=texts.offset)


def _mixed(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of the phrase without its last word, and of that word."""
    h = before * np.uint64(0x9E3779B97F4A7C15) + last
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Proposal:
    """The bits of hashed phrases."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def holds(self, h: np.ndarray) -> np.ndarray:
        at = h & np.uint64(8 * len(self.bits) - 1)
        return self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1


def occurrences(langs: pa.Array, texts: pa.Array, longest: int, proposal: Proposal | None = None, frequent: Proposal | None = None) -> Iterator[pa.RecordBatch]:
    """Counts of a part's phrases by size.

    Without a proposal (h, n) of all phrases. With one, of the phrases whose parts it holds. With the
    bits of what may be `frequent` as well, (lang, phrase, size, n) of those and of what wasn't counted
    by the proposal though both its parts are told here; n words of a language as a phrase of no words.
    """
    ranked = langs.dictionary_encode()
    names = ranked.dictionary
    split = pc.split_pattern(pc.replace_substring(_lowered(texts), "\n", " \n "), " ")
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    ends, gaps = (code == words.index(x).as_py() for x in ("\n", ""))
    word = ~(ends | gaps)
    # Words of one number follow one another within a piece.
    piece = (np.cumsum(ends) + doc)[word]
    code, doc = code[word], doc[word]
    if not len(code):
        return
    at, kinds = pd.factorize(ranked.indices.to_numpy(zero_copy_only=False).astype(np.int64)[doc] * len(words) + code)
    lang, last = kinds // len(words), words.take(pa.array(kinds % len(words)))
    tags = [x.encode() + b"\0" for x in names.to_pylist()]
    word_h = np.fromiter((xxh64_intdigest(tags[k] + w) for k, w in zip(lang.tolist(), pc.cast(last, pa.binary()).to_pylist(), strict=True)), np.uint64, len(kinds))

    def rows(size: int, n: np.ndarray, told: np.ndarray) -> Iterator[pa.RecordBatch]:
        if frequent is None:
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])
        elif told.any():
            chosen = pa.array(np.flatnonzero(told))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(lang[told])), phrase.take(chosen), pa.array(np.full(len(chosen), size, "<i4")), pa.array(n[told])], ["lang", "phrase", "size", "n"])

    n = np.bincount(at, minlength=len(kinds))
    if frequent is not None:
        by_lang = np.bincount(lang, n, len(names)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([names, pa.array([""] * len(names)), pa.array(np.zeros(len(names), "<i4")), pa.array(by_lang)], ["lang", "phrase", "size", "n"])
    first, phrase, h = at, last, word_h
    every = np.ones(len(kinds), bool)
    # `counted` by the proposal, and `told`: what a longer phrase may be made of.
    counted, told = every, every if proposal is None else proposal.holds(h) if frequent is None else frequent.holds(h)
    yield from rows(1, n, told)
    for size in range(2, longest + 1):
        # `first` numbers the phrase of size - 1 words that begins at a word, -1 where there is none.
        near = np.flatnonzero(piece[: 1 - size] == piece[size - 1 :]) if len(piece) >= size else np.zeros(0, np.int64)
        near = near[(first[near] >= 0) & (first[near + 1] >= 0)]
        near = near[told[first[near]] & told[first[near + 1]]]
        if not len(near):
            return
        found, pairs = pd.factorize(first[near] * len(kinds) + at[near + size - 1])
        n = np.bincount(found, minlength=len(pairs))
        before, end = pairs // len(kinds), pairs % len(kinds)
        place = np.zeros(len(pairs), np.int64)
        place[found] = near
        rest = first[place + 1]
        if frequent is not None:
            known = counted & proposal.holds(h)
            counted = known[before] & known[rest]
            phrase = pc.binary_join_element_wise(phrase.take(pa.array(before)), last.take(pa.array(end)), " ")
            lang = lang[before]
        h = _mixed(h[before], word_h[end])
        told = np.ones(len(pairs), bool) if proposal is None else proposal.holds(h) if frequent is None else ~counted | frequent.holds(h)
        yield from rows(size, n, told)
        first = np.full(len(piece), -1, np.int64)
        first[near] = found


def _pass(docs: DataFrame, longest: int, *held: np.ndarray) -> DataFrame:
    """Counts of each part of the documents (lang, text), to be summed up."""
    sent = [docs.sparkSession.sparkContext.broadcast(x) for x in held]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [Proposal(x.value) for x in sent]
        for part in by_bytes(batches, 1, _TEXT_BYTES):
            yield from occurrences(part.column(0), part.column(1), longest, *bits)

    return docs.mapInArrow(run, _FIELDS if len(held) == 2 else "h long, n long")


def _bitmap(counts: DataFrame, least: int) -> np.ndarray:
    """The bits of hashes (h, n) that are counted `least` times, put together where their rows are; blocks of 4 KB reach the driver, MOST_BITS at most."""
    kept = stored(counts.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("h"))
    many, bits = kept.count(), LEAST_BITS
    while bits < min(16 * many, MOST_BITS):
        bits *= 2
    at = F.col("h").bitwiseAND(F.lit(bits - 1)) + 1
    blocks = kept.groupBy(F.bitmap_bucket_number(at).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in blocks.toLocalIterator():
        out[(r.block - 1) * 4096 : r.block * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, sample: int = SAMPLE, sample_support: int = SAMPLE_SUPPORT) -> DataFrame:
    """(lang, phrase, size, n): every phrase of up to `longest` words with `support` occurrences, and each language's words as size 0.

    `docs` has lang, text and doc_id; documents whose hashed id falls into one of `sample` parts are the
    sample, in which a phrase must occur `sample_support` times to be proposed. Both numbers only change
    how much is counted: a frequent phrase has frequent parts, so it is counted in the first pass, or in
    the second because its parts are.
    """
    texts = docs.select("lang", "text")
    drawn = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(sample)) == 0).select("lang", "text")
    with small_batches(docs.sparkSession):
        proposal = _bitmap(_pass(drawn, longest), sample_support)
        frequent = _bitmap(_pass(texts, longest, proposal), support)
        sums = _pass(texts, longest, proposal, frequent).groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"))
        return stored(sums.where((F.col("n") >= support) | (F.col("size") == 0)))


def _joined(words: str, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored(frequent: DataFrame, cover: int = COVER) -> DataFrame:
    """(lang, phrase, a, l, r, score) of phrases of two words and more that no longer one covers.

    Of the cuts of a phrase the one with the lowest score counts, then the one after fewer words. Both
    parts of a cut are frequent, so their counts are at hand. Products are decimals of 38 digits.
    """
    long = frequent.where("size >= 2").select("lang", "phrase", F.col("n").alias("a"), "size", F.split("phrase", " ").alias("w"))
    counts = frequent.where("size >= 1").select(F.col("lang").alias("of_lang"), F.col("phrase").alias("of"), F.col("n").alias("f"))
    cuts = long.select("lang", "phrase", "a", "size", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _joined("w", F.lit(1), F.col("k")).alias("one"), _joined("w", F.col("k") + 1, F.col("size") - F.col("k")).alias("two"))
    with_l = cuts.join(counts.withColumnRenamed("f", "l"), (F.col("lang") == F.col("of_lang")) & (F.col("one") == F.col("of"))).drop("of_lang", "of")
    with_r = with_l.join(counts.withColumnRenamed("f", "r"), (F.col("lang") == F.col("of_lang")) & (F.col("two") == F.col("of"))).drop("of_lang", "of")
    score = F.expr("CAST(CAST(a AS DECIMAL(31, 0)) * CAST(2000000 AS DECIMAL(7, 0)) AS DECIMAL(38, 0)) div (CAST(l AS DECIMAL(38, 0)) + CAST(r AS DECIMAL(38, 0)))")
    lowest = with_r.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    inner = F.explode(F.expr("flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), s -> array_join(slice(w, s, m), ' '))))"))
    held = long.where("size >= 3").select("lang", "a", inner.alias("of")).groupBy(F.col("lang").alias("of_lang"), "of").agg(F.max("a").alias("longer"))
    out = lowest.join(held, (F.col("lang") == F.col("of_lang")) & (F.col("phrase") == F.col("of")), "left")
    covered = F.col("longer").cast("decimal(31,0)") * 100 >= F.col("a").cast("decimal(31,0)") * cover
    return out.where(~F.coalesce(covered, F.lit(False))).select("lang", "phrase", "a", "m.l", "m.r", F.col("m.score").cast("long").alias("score"))


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, cover: int = COVER, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score.

    A null language is `und`, a null text is as empty; repeated rows all count and null ids do no harm;
    other columns are not read; an empty table gives no rows. Ties of the score go by occurrences, then
    by the phrase's bytes. Candidates are dealt to SALTS parts whose best are ranked together.
    """
    chosen = docs.select(F.coalesce(F.col(lang_col), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).alias("doc_id"))
    frequent = frequent_phrases(chosen, support, longest)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = scored(frequent, cover).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    part = dealt.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= top)
    best = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    n = frequent.where("size = 0").select(F.col("lang").alias("of_lang"), F.col("n"))
    return best.join(n, F.col("lang") == F.col("of_lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same by counting every phrase.
ORACLE_SQL = f"""
WITH d AS (SELECT coalesce(lang, '{NO_LANG}') AS lang, row_number() OVER () AS doc, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\x09]+'), lambda x: x <> '') AS w FROM p),
f AS (SELECT lang, size, array_to_string(w[s : s + size - 1], ' ') AS phrase, count(*) AS n FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM w, range(1, {LONGEST + 1}) z(size) WHERE len(w) >= size) GROUP BY ALL),
total AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE size >= 2 AND n >= {SUPPORT}),
cut AS (SELECT c.lang, c.phrase, c.a, k, l.n AS l, r.n AS r, CAST(2000000 AS HUGEINT) * c.a // (l.n + r.n) AS score
  FROM (SELECT *, unnest(range(1, c.size)) AS k FROM c) c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1 : c.size], ' ')),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
held AS (SELECT lang, array_to_string(w[s : s + m - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT *, unnest(range(1, size - m + 2)) AS s FROM c, range(2, {LONGEST}) z(m) WHERE m < size) GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN held USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {COVER} * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM kept JOIN total USING (lang) QUALIFY rank <= {TOP}
"""
