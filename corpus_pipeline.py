"""From raw documents to packed sequences: five stages, each over all that the one before it kept."""

from __future__ import annotations

from public_tokenizers import path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landmosaic.llm import langid, packing, simhash, suffix, toxicity
from landmosaic.llm.common import cut, held_out, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: Near copies: words of a shingle and the likeness from which texts are such.
SHINGLE, LIKENESS = 5, 0.8


def _keyed(docs: DataFrame) -> DataFrame:
    """The columns of documents, and a key: 128 bits of the whole row, nulls told apart, so rows of one id or none are told apart too."""
    told = F.to_json(F.struct(*COLUMNS), {"ignoreNullFields": "false"})
    return docs.select(COLUMNS).withColumn("key", F.md5(told))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without letters, or whose text fits none of the languages, go."""
    rows = _keyed(docs).withColumn("n", F.xxhash64("key"))
    kept = langid.identify_documents(rows.withColumn("doc_id", F.col("n"))).where("accepted").select(F.col("doc_id").alias("kept")).distinct()
    return rows.join(kept, F.col("n") == F.col("kept"), "left_semi").select(COLUMNS)


def toxic_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't score as toxic, by labels of those not held out."""
    found = toxicity.scored(docs, table(spark, sf_dir, "labels"), held_out("doc_id", 5, 0), tuple(COLUMNS))
    return found.where("predicted = 0").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id, and of rows repeated as a whole one.

    Equal texts are one before the search; texts without words, null ones too, are no copies of others. Null ids come last.
    """
    rows = _keyed(docs).withColumn("text_key", F.when(F.trim(F.regexp_replace("text", r"[\t-\r]", " ")) != "", F.md5("text")).otherwise(F.col("key")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")).alias("first")
    texts = cut(rows.groupBy("text_key").agg(first).select("first", F.col("first.key").alias("of")).withColumn("n", F.monotonically_increasing_id()))
    # A row that is repeated as a whole gives its text once.
    read = rows.dropDuplicates(["key"]).join(texts.select("of", "n"), F.col("key") == F.col("of")).select("n", "text")
    found = simhash.groups(read, "n", "text", SHINGLE, LIKENESS)
    kept = texts.join(found, F.col("n") == F.col("id")).groupBy("group").agg(F.min("first").alias("first")).select(F.col("first.key").alias("kept"))
    return rows.join(kept, F.col("key") == F.col("kept"), "left_semi").dropDuplicates(["key"]).select(COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that occur earlier; of characters that lose some of their bytes the rest goes too."""
    kept = suffix.repeats(docs, also=("lang", "source"))
    # try_validate_utf8 gives null where a character lost bytes; only these texts are mended.
    whole = F.expr("try_validate_utf8(CAST(kept AS STRING))")
    mended = F.regexp_replace(F.expr("make_valid_utf8(CAST(kept AS STRING))"), "�", "")
    text = F.when(whole.isNotNull(), whole).otherwise(mended)
    return kept.select("doc_id", text.alias("text"), "lang", "source").select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids in sequences of 4096."""
    return packing.pack(docs, path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxic_filter),
    ("simhash", near_duplicates),
    ("suffix_dedup", suffix_dedup),
    ("packing", pack),
]

#: Models, fingerprints and token ids are beyond SQL; tests hold each stage against a brute-force form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what one returns is written as Parquet in the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
