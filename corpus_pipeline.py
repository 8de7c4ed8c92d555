"""Documents to packed training sequences: language ID, near-dedup, substring dedup, mixing, packing.

Every stage but the last takes and returns the columns of documents; other columns, also of clashing names, are dropped. An
empty table gives an empty table in every stage. Repeated rows and ties are settled by each stage's operator, as said
there; very long texts pass every stage whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photowarden.llm import common, langid, mixing, neardup, packing, substring
from photowarden.llm.catalog import MIX_TARGETS

#: Score from which a predicted language replaces a label that it contradicts.
RELABEL = 0.9
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null or empty text, no letter) go. The others get the predicted language where they
    have none, or where the prediction contradicts theirs with a score of at least RELABEL. Without a usable label in any
    row nothing can be learned: then lang stays as it is. A null doc_id or source changes nothing; equal texts with equal
    labels have equal results."""
    model = langid.train(*langid.training_sample(docs))
    if model is None:
        return langid.with_letters(docs.select(*COLUMNS))
    kept = langid.predict(docs.select(*COLUMNS), model).filter("lang_pred <> 'und'")
    lang = F.when(F.col("lang").isNull() | (F.col("score") >= RELABEL), F.col("lang_pred")).otherwise(F.col("lang"))
    return kept.withColumn("lang", lang).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: the one with the smallest id. Five-word shingles. Rows that share an id stay or
    go together; a null id, and a text without words, is linked with nothing and stays."""
    return neardup.near_duplicates(docs.select(*COLUMNS), size=5).filter("kept").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated windows are cut out and n_chars follows; a document with nothing left goes, one that had no words stays."""
    cut = substring.dedup_windows(docs.select(*COLUMNS)).filter("n_removed < n_words or n_words = 0")
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled so that sources, languages and layouts have their target shares of tokens. Null values are
    values of their own; a text without words has no weight and goes; rows that share an id share its draw."""
    counted = docs.select(*COLUMNS).withColumns({"topic": mixing.text_topic(), "tokens": mixing.count_tokens()})
    return mixing.mix_to_targets(counted, MIX_TARGETS).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens: the columns of op 8's contract. A null text is its end token."""
    return packing.pack_documents(docs.select(*COLUMNS))


STAGES = [("language ID", language), ("MinHash near-dedup", near_dedup), ("substring dedup", substring_dedup), ("mixing", mix), ("packing", pack)]

#: SQL can't express the network of the first stage; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tables = common.table(spark, sf_dir, "documents"), common.Scratch(spark)
    for name, stage in STAGES:
        docs = tables.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        tables.keep(name.replace(" ", "-"))
    return docs
