"""Language identification by Bayesian fusion of text, declared language, address suffix and host."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, slices

#: Hashed runs of three letters (bytes) that the text model counts, at most, and bytes of the model: with many languages fewer runs.
MOST_BUCKETS = 1 << 16
MODEL_BYTES = 64 << 20
#: How many letter runs' worth a text's evidence counts at most; the runs of a text are not independent.
TEXT_WEIGHT = 64
#: Probability that a declared language is the true one, and that a text is in no language that rows declare.
TRUST = 0.9
OTHER = 0.01
#: Share of a text whose letter runs needn't be those of its language: names, keys, numbers.
STRAY = 0.1
#: Rows that a suffix's prior counts as much as, and a host's.
SMOOTH = 20.0
ACCEPT = 0.5
#: Languages whose likelihood is so many nats below the best can't count: no prior is that small.
FAR = 200.0
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MARKUP_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.IGNORECASE)
_HIDDEN = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->", re.IGNORECASE | re.DOTALL)
_TAG = re.compile(r"<[^>]*>")


def letters_of(text: str) -> np.ndarray:
    """Lower-case bytes of a text's letters; whatever is no letter counts as a space, of which no two stand together."""
    return np.frombuffer(b" " + b" ".join(text.encode().translate(_LETTERS).lower().split()) + b" ", np.uint8)


def runs(x: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of the runs of three letters."""
    x = x.astype(np.uint32)
    return ((x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2654435761) >> np.uint32(33 - buckets.bit_length())).astype(np.int64) if len(x) > 2 else np.zeros(0, np.int64)


def code_of(declared: Column) -> Column:
    """The language of a declaration such as en or de-AT: two or three letters a to z, so there are 18,252 at most; else null."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(declared.cast("string"))), "^([a-z]{2,3})(?:[-_].*)?$", 1), F.lit(""))


class Model:
    """Probabilities of letter runs by language, and log probabilities of letters in all languages.

    A run of letters has, in part STRAY, the probability of its letters in any order, whatever the language.
    """

    def __init__(self, langs: list[str], runs_by_lang: np.ndarray, letters: np.ndarray):
        self.langs = langs
        self.table = (runs_by_lang / np.maximum(1, runs_by_lang.sum(axis=1, keepdims=True))).T.astype(np.float32)
        self.letters = np.log(letters / letters.sum())

    def likelihoods(self, text: str) -> tuple[int, np.ndarray, float]:
        """(letter runs, log likelihood by language, that of letters in any order), tempered."""
        x = letters_of(text)
        found = runs(x, len(self.table))
        by_letter = self.letters[x]
        stray = by_letter[:-2] + by_letter[1:-1] + by_letter[2:] if len(found) else np.zeros(0)
        share = min(1.0, TEXT_WEIGHT / max(1, len(found)))
        likelihood = np.log((1 - STRAY) * self.table[found] + STRAY * np.exp(stray)[:, None]).sum(axis=0, dtype=np.float64)
        return len(found), likelihood * share, float(stray.sum()) * share


def text_model(docs: DataFrame, text_col: str, lang_col: str) -> Model:
    """Counted over all rows that declare a language; every language that any row declares takes part."""
    named = docs.select(code_of(F.col(lang_col)).alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    langs = sorted(r.lang for r in named.select("lang").distinct().collect())
    buckets = MOST_BUCKETS
    while buckets * 4 * len(langs) > MODEL_BYTES:
        buckets //= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        letters = np.zeros(256, np.int64)
        for part in slices(batches):
            by: dict[str, list[str]] = {}
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                x = letters_of(" ".join(texts))
                letters += np.bincount(x, minlength=256)
                sums[lang] = sums.get(lang, 0) + np.bincount(runs(x, buckets), minlength=buckets)
        for k, n in [(-1, letters), *((langs.index(lang), n) for lang, n in sums.items())]:
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])

    table, letters = np.zeros((len(langs), buckets), np.float32), np.full(256, 0.5)
    for r in named.mapInArrow(run, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        if r.lang < 0:
            letters[r.bucket] += r.n
        else:
            table[r.lang, r.bucket] += r.n
    return Model(langs, table, letters)


def page_text(html: str) -> str:
    return unescape(_TAG.sub(" ", _HIDDEN.sub(" ", html)))


def declared_in(html: str) -> str | None:
    found = _MARKUP_LANG.search(html)
    return found[1].lower() if found else None


def evidence(rows: DataFrame, model: Model, id_col: str, text_col: str, host: Column, suffix: Column, declared: Column | None) -> DataFrame:
    """(id, host, suffix, declared, letters, found, other): log likelihoods of the text in each language it may be in, and in none.

    Where `declared` is None, texts are markup: the language is what the markup declares, and tags go.
    """
    sent = rows.sparkSession.sparkContext.broadcast(model)
    markup = declared is None
    fields = pa.list_(pa.struct([("lang", pa.string()), ("l", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        place = {lang: k for k, lang in enumerate(known.langs)}
        for part in slices(batches):
            ids, texts, hosts, suffixes, told = (part.column(k) for k in range(5))
            texts, told = [t or "" for t in texts.to_pylist()], told.to_pylist()
            if markup:
                told = list(map(declared_in, texts))
                texts = list(map(page_text, texts))
            letters, found, others = [], [], []
            for text, lang in zip(texts, told, strict=True):
                n, likelihood, other = known.likelihoods(text)
                near = np.flatnonzero(likelihood >= max(likelihood.max(initial=other), other) - FAR).tolist()
                if lang in place and place[lang] not in near:
                    near.append(place[lang])
                letters.append(n)
                found.append([{"lang": known.langs[k], "l": likelihood[k]} for k in sorted(near)])
                others.append(other)
            yield pa.RecordBatch.from_arrays([ids, hosts, suffixes, pa.array(told, pa.string()), pa.array(letters, pa.int64()), pa.array(found, fields), pa.array(others, pa.float64())], ["id", "host", "suffix", "declared", "letters", "found", "other"])

    chosen = rows.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(suffix, F.lit("")).alias("suffix"),
        F.lit(None).cast("string").alias("declared") if markup else code_of(declared).alias("declared"),
    )
    return chosen.mapInArrow(run, "id long, host string, suffix string, declared string, letters long, found array<struct<lang: string, l: double>>, other double")


def _count_map(counts: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, name): declared languages with their numbers, one map for each key; a map has 18,252 entries at most."""
    by = counts.groupBy(*keys, "declared").agg(F.sum("n").alias("n"))
    return by.groupBy(*[F.col(k).alias(f"{name}_{k}") for k in keys]).agg(F.map_from_entries(F.collect_list(F.struct("declared", "n"))).alias(name))


def identify(rows: DataFrame, model: Model, id_col: str, text_col: str, host: Column, suffix: Column, declared: Column | None = None) -> DataFrame:
    """id, language, confidence, declared, text_language, accepted of every row.

    P(language | all) is in proportion to P(text | language) P(declared | language) P(language | host).
    The last is counted from the languages that other rows declare: over all rows, then by suffix with
    the former as prior, then by host with that of its suffix as prior; a row's own declaration is left
    out of all three. Undeclared or unknown languages say nothing. That a text is in none of the
    languages has the probability OTHER beforehand and the likelihood of its letters in any order.
    Texts without letters leave it to the rest, and aren't accepted; nor are rows whose best language
    has a probability under ACCEPT. Null texts and hosts are as empty; repeated rows keep a row each;
    ties go to the first language; an empty table gives no rows; without any declared language in the
    training rows the language is null. Other columns are not read.
    """
    langs = model.langs
    seen = cut(evidence(rows, model, id_col, text_col, host, suffix, declared))
    if not langs:
        return seen.select("id", F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("confidence"), "declared", F.lit(None).cast("string").alias("text_language"), F.lit(False).alias("accepted"))
    here = F.transform("found", lambda x: x["lang"])
    counts = cut(seen.where(F.array_contains(here, F.col("declared"))).groupBy("host", "suffix", "declared").agg(F.count("*").alias("n")))
    every = _count_map(counts, [], "of_all")
    met = seen.join(_count_map(counts, ["host", "suffix"], "of_host"), (F.col("host") == F.col("of_host_host")) & (F.col("suffix") == F.col("of_host_suffix")), "left")
    met = met.join(_count_map(counts, ["suffix"], "of_suffix"), F.col("suffix") == F.col("of_suffix_suffix"), "left").crossJoin(F.broadcast(every))
    # Languages that rows of this table don't declare have no entry in any map.
    known = F.coalesce(F.array_contains(here, F.col("declared")), F.lit(False))
    own = F.when(known, 1.0).otherwise(0.0)
    whole = {name: F.aggregate(F.map_values(F.coalesce(name, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>")))), F.lit(0.0), lambda s, x: s + x) - own for name in ("of_host", "of_suffix", "of_all")}
    sized = met.select("*", known.alias("known"), *[v.alias(f"size_{k}") for k, v in whole.items()])

    def prior(lang: Column) -> Column:
        mine = F.when(F.col("known") & (lang == F.col("declared")), 1.0).otherwise(0.0)
        n = lambda name: F.coalesce(F.try_element_at(name, lang), F.lit(0)) - mine
        p = (n("of_all") + 1.0) / (F.col("size_of_all") + len(langs))
        p = (n("of_suffix") + SMOOTH * p) / (F.col("size_of_suffix") + SMOOTH)
        return (n("of_host") + SMOOTH * p) / (F.col("size_of_host") + SMOOTH)

    told = lambda lang: F.when(~F.col("known"), 0.0).when(lang == F.col("declared"), math.log(TRUST)).otherwise(math.log((1 - TRUST) / max(1, len(langs) - 1)))
    scored = F.transform("found", lambda x: F.struct((x["l"] + told(x["lang"]) + F.log(prior(x["lang"])) + math.log(1 - OTHER)).alias("score"), x["lang"].alias("lang"), x["l"].alias("l")))
    none = F.col("other") + F.when(F.col("known"), -math.log(len(langs))).otherwise(0.0) + math.log(OTHER)
    best = sized.select("*", scored.alias("scored"), none.alias("none")).select("*", F.array_max(F.transform("scored", lambda x: x["score"])).alias("top"))
    first = lambda field, value: F.element_at(F.filter("scored", lambda x: x[field] == value), 1)["lang"]
    mass = F.aggregate("scored", F.exp(F.col("none") - F.col("top")), lambda s, x: s + F.exp(x["score"] - F.col("top")))
    out = best.select("id", first("score", F.col("top")).alias("language"), (F.lit(1.0) / mass).alias("confidence"), "declared", first("l", F.array_max(F.transform("scored", lambda x: x["l"]))).alias("text_language"), "letters")
    return out.select("id", "language", "confidence", "declared", "text_language", ((F.col("letters") > 0) & (F.col("confidence") >= ACCEPT)).alias("accepted"))


def identify_pages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """Languages of web pages (page_id, url, html); the text model comes from the documents' texts and languages."""
    host = F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    model = text_model(docs, "text", "lang")
    return identify(pages, model, "page_id", "html", host, F.regexp_extract(host, r"([^.]*)$", 1)).withColumnRenamed("id", "page_id")


def identify_documents(docs: DataFrame) -> DataFrame:
    """Languages of documents (doc_id, text, lang, source): the declared one is lang, the source stands for the host."""
    model = text_model(docs, "text", "lang")
    found = identify(docs, model, "doc_id", "text", F.col("source").cast("string"), F.lit(""), F.col("lang"))
    return found.withColumnRenamed("id", "doc_id")
