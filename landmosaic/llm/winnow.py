"""Winnowing fingerprints of whole texts in Spark SQL expressions alone.

A text's units are its words; of a run of over 16 characters without white space, as in scripts that
don't space words, each character is one. So units don't depend on where a run begins. A gram is K
units. Of every W consecutive grams the one with the smallest hash is kept, of equal ones the
rightmost, with its place. So two texts that share K + W - 1 units share a kept gram. A text with
few grams keeps all, which are a superset of what windows keep, and one with fewer units than
that also keeps all its runs of K characters.

Hashes roll by doubling: the hash of 2n units is made of two hashes of n units, and the minimum of 2n
grams of two minima of n grams, each for all places at once. A gram is one long, its hash in the
upper 33 bits and its place counted down in the lower 31, so the smaller long is the smaller hash
and, among equals, the rightmost place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Units of a gram and grams of a window: powers of two.
K = 4
W = 8
UNIT = r"(?<!\\S)\\S{1,16}+(?!\\S)|\\S"
_PLACE = 2147483647
#: Rows of one range of ids, about, and ranges at most, about.
RANGE_ROWS = 1024
MOST_RANGES = 1 << 16


def _let(name: str, value: str, body: str) -> str:
    """A value computed once per row and used in body by name."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _doubled(array: str, upto: int, join: str, body: str) -> str:
    """body, with `d` for the array joined over `upto` neighbours; the last places hold fewer."""
    width, steps = 1, []
    while width < upto:
        steps.append(width)
        width *= 2
    for step in reversed(steps):
        body = _let("d", f"zip_with(d, slice(d, {step + 1}, size(d)), (l, r) -> {join})", body)
    return _let("d", array, body)


def _grams(array: str, k: int, first: str) -> str:
    """SQL of the grams of k hashed units with their places, counted from `first`; fewer than k units are one gram."""
    packed = f"transform(slice(d, 1, size(d) - {k - 1}), (x, i) -> (x & {-(_PLACE + 1)}L) | ({_PLACE}L - {first} - i))"
    whole = f"array((xxhash64(a) & {-(_PLACE + 1)}L) | ({_PLACE}L - {first}))"
    return _let("a", array, f"if(size(a) < {k}, if(size(a) = 0, CAST(array() AS ARRAY<BIGINT>), {whole}), {_doubled('a', k, 'xxhash64(l, r)', packed)})")


def winnowed(text: str, k: int = K, w: int = W) -> str:
    """SQL of the kept grams of a text: array<bigint>, each once, places from 0 in units; those of characters come after."""
    letters = _grams(f"transform(regexp_extract_all({text}, '(?s).', 0), x -> xxhash64(x, 'letter'))", k, "size(u)")
    least = _doubled("g", w, "least(l, r)", f"array_distinct(slice(d, 1, size(g) - {w - 1}))")
    kept = _let("g", _grams("transform(u, x -> xxhash64(x))", k, "0"), f"if(size(g) < {4 * w}, if(size(u) < {k + w}, concat(g, {letters}), g), {least})")
    return _let("u", f"regexp_extract_all({text}, '{UNIT}', 0)", f"if(size(u) = 0, CAST(array() AS ARRAY<BIGINT>), {kept})")


def hashes(kept: str) -> str:
    """SQL of the distinct hashes of kept grams, in rising order."""
    return f"sort_array(array_distinct(transform({kept}, x -> CAST(shiftright(x, 32) AS INT))))"


def places(kept: str) -> str:
    """SQL of the places of kept grams, in units from 0, in rising order."""
    return f"sort_array(transform({kept}, x -> CAST({_PLACE}L - (x & {_PLACE}L) AS INT)))"


def likeness(x: str, y: str) -> str:
    """SQL of the Jaccard likeness of two arrays of distinct hashes; two empty ones are alike."""
    return _let("common", f"size(array_intersect({x}, {y}))", f"if(size({x}) + size({y}) = 0, 1.0D, CAST(common AS DOUBLE) / (size({x}) + size({y}) - common))")


def _digits(of: str) -> str:
    return f"concat_ws('', transform({of}, h -> lpad(hex(CAST(h AS BIGINT) & 4294967295L), 8, '0')))"


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """(doc_id, fingerprint, places): hex digits of the distinct hashes, and the unit at which each kept gram starts.

    A null text is as empty: no hashes. Repeated rows keep a row each; other columns are not read.
    """
    text = f"coalesce(CAST(`{text_col}` AS STRING), '')"
    kept = docs.selectExpr(f"`{id_col}` AS doc_id", f"{winnowed(text, k, w)} AS kept")
    return kept.selectExpr("doc_id", f"{_digits(hashes('kept'))} AS fingerprint", f"{places('kept')} AS places")


def _narrowed(rows: DataFrame, splits: list[DataFrame]) -> DataFrame:
    """Adds `at`, the range of (id, key) that a row falls into after all splits; nulls have ranges of their own."""
    rows = rows.withColumn("at", F.when(F.col("id").isNull(), 1).otherwise(0).cast("long"))
    for split in splits:
        value = F.when(F.col("by_id"), F.col("id")).otherwise(F.col("key"))
        # Halves, so that no difference leaves 64 bits.
        half = F.expr("(shiftright(CASE WHEN by_id THEN id ELSE key END, 1) - shiftright(low, 1)) div width")
        nth = F.when(F.col("width") > 0, half).otherwise(value - F.col("low"))
        met = rows.join(F.broadcast(split), F.col("at") == F.col("of"), "left")
        rows = met.withColumn("at", F.when(F.col("of").isNull(), F.col("at")).otherwise(F.xxhash64("at", nth))).select(rows.columns)
    return rows


def _ranges(kinds: DataFrame, rows: int) -> list[DataFrame]:
    """Splits of the (id, key) of kinds (id, key, n) by which no range has many more than its share of rows.

    A range with too many is cut into equally wide ones, by key where it has one id, until each is
    small enough or one kind: once for ids without large gaps, and at most a few times for any.
    """
    share = max(RANGE_ROWS, rows // MOST_RANGES)
    splits: list[DataFrame] = []
    while True:
        found = _narrowed(kinds, splits).groupBy("at").agg(F.sum("n").alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("id", "key") for f in (F.min, F.max)])
        by_id = F.coalesce(F.col("min_id") < F.col("max_id"), F.lit(False))
        wide = found.where(F.col("n") > 2 * share).where(by_id | (F.col("min_key") < F.col("max_key")))
        low, high = (F.when(by_id, F.col(f"{f}_id")).otherwise(F.col(f"{f}_key")) for f in ("min", "max"))
        told = wide.select(F.col("at").alias("of"), by_id.alias("by_id"), low.alias("low"), high.alias("high"), F.ceil(F.col("n") / share).alias("parts"))
        split = cut(told.selectExpr("of", "by_id", "low", "CASE WHEN shiftright(high, 1) = shiftright(low, 1) THEN 0 ELSE (shiftright(high, 1) - shiftright(low, 1)) div parts + 1 END AS width"))
        if split.isEmpty():
            return splits
        splits.append(split)


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """Fingerprints of every text and of its edited text, how like they are, and the places of the text's kept grams.

    Edited: the last floor(n_chars / 3) code points give way to the first as many of the next
    document's text, or all it has. Null texts are as empty. Rows of one id follow each other in
    order of their texts' hashes, so a repeated row is followed by its copy; a single row follows
    itself; null ids come after all others; an empty table gives no rows. Other columns are not read.

    Texts move once: to the range of ids they belong to, about RANGE_ROWS rows that one window sees.
    The first row of each range also goes, as a guest, to the range before it. Which rows these are
    comes from ids and texts' hashes alone; ranges are about MOST_RANGES at most, so they are
    broadcast. Rows repeated as a whole are one row with a count on the way, where there are any.
    """
    base = docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS id", f"coalesce(CAST(`{text_col}` AS STRING), '') AS text").selectExpr("id", "xxhash64(text) AS key", "text")
    kinds = cut(base.groupBy("id", "key").agg(F.count("*").alias("n")))
    rows, copies = kinds.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(1))).first()
    splits = _ranges(kinds.withColumn("n", F.lit(1).cast("long")), rows)
    first = F.max(F.struct("id", "key"))
    falling = Window.orderBy(F.desc_nulls_last("head.id"), F.desc("head.key"))
    heads = _narrowed(kinds.select("id", "key"), splits).groupBy("at").agg(first.alias("head"))
    last = F.last("at").over(falling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select(F.col("at").alias("head_at"), "head", F.coalesce(F.lag("at").over(falling), last).alias("host"))
    single = base.groupBy("id", "key", "text").agg(F.count("*").alias("n")) if copies > 1 else base.withColumn("n", F.lit(1).cast("long"))
    kept = _narrowed(single, splits).selectExpr("id", "at", "key", "n", "text", f"{winnowed('text', k, w)} AS kept")
    hosted = kept.join(F.broadcast(heads), (F.col("at") == F.col("head_at")) & F.col("id").eqNullSafe(F.col("head.id")) & (F.col("key") == F.col("head.key")), "left")
    sent = hosted.withColumn("to", F.explode(F.expr("if(host IS NULL, array(struct(at, false AS guest)), array(struct(at, false AS guest), struct(host AS at, true AS guest)))")))
    sent = sent.select("to.at", "to.guest", "id", "key", "n", "text", "kept")
    order = Window.partitionBy("at").orderBy("guest", F.desc_nulls_last("id"), F.desc("key"))
    both = sent.select("id", "n", "guest", "text", "kept", F.lead("text").over(order).alias("next_text"), F.lead("kept").over(order).alias("next_kept")).where("NOT guest").drop("guest")
    if copies > 1:
        again = both.where("n > 1").select("id", F.explode(F.expr("sequence(2L, n)")).alias("n"), "text", "kept", F.col("text").alias("next_text"), F.col("kept").alias("next_kept"))
        both = both.union(again)
    edited = both.selectExpr("id", "CAST(char_length(text) AS BIGINT) AS n_chars", "text", "kept", "next_text", "next_kept").selectExpr(
        "id", "n_chars", "kept", "next_kept", "concat(substring(text, 1, CAST(n_chars - n_chars div 3 AS INT)), substring(next_text, 1, CAST(n_chars div 3 AS INT))) AS edited"
    )
    done = edited.selectExpr(
        "id", "n_chars", "sha2(edited, 256) AS edited_sha256", f"{hashes('kept')} AS own", f"{hashes('next_kept')} AS next", f"{hashes(winnowed('edited', k, w))} AS other", f"{places('kept')} AS places"
    )
    return done.selectExpr(
        "id AS doc_id", "n_chars", "edited_sha256", f"{_digits('own')} AS fingerprint", f"{_digits('other')} AS edited_fingerprint",
        f"{likeness('own', 'other')} AS near_edited", f"{likeness('own', 'next')} AS near_next", "places",
    )
