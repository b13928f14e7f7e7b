"""A training corpus from `documents`: language, near copies, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next
one's docs. All but the last keep the columns of documents. SQL can express neither the language model nor the
optimal buckets, so there is no ORACLE_SQL; tests/llm hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import decontaminate, jaccard, langid, packing, pii
from palimpsest.llm.common import stage, table


USED = ("doc_id", "text", "lang", "n_chars")


def shielded(docs: DataFrame) -> DataFrame:
    """docs with the columns that no stage uses renamed, so that none of them clashes with what an operator adds."""
    return docs.toDF(*[c if c in USED else f"__c{i}" for i, c in enumerate(docs.columns)])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language: those without a letter, or whose best code is near that of noise, go.

    Null and empty texts have no letter and go; ids and other columns may be null or repeated and are kept as they
    are; if no row has a language to learn from, all go; an empty table stays empty."""
    own = shielded(docs)
    got = langid.predict(own, langid.fit(own), keep=tuple(own.columns))
    kept = got.filter((F.col("lang_pred") != "und") & (F.col("bits_per_byte") <= langid.FOREIGN))
    return kept.select(*own.columns).toDF(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id (a null id comes last).

    Documents without words stay; of equal rows, and of rows with one id and text, one stays; an empty table stays empty."""
    return jaccard.one_of_each(shielded(docs)).toDF(*docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the passages of benchmark items; documents that are mostly such passages go.

    Null and empty texts and repeated rows stay as they are; an empty benchmark changes nothing."""
    own = shielded(docs)
    got = decontaminate.decontaminate(own, table(spark, sf_dir, "benchmark"), keep=tuple(own.columns))
    text = F.coalesce("clean_text", "text")
    return got.filter(~F.col("drop")).withColumns({"n_chars": F.when(F.col("contaminated"), F.length(text)).otherwise(F.col("n_chars")).cast("long"), "text": text}).select(*own.columns).toDF(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With personal data, and terms that reveal it, written as their kinds.

    Null and empty texts stay; equal texts are rewritten alike; an empty table stays empty."""
    return pii.sanitise(shielded(docs)).withColumn("n_chars", F.length("text").cast("long")).toDF(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's length bucket and batch. Null and empty texts are an end token alone; each repeated row is packed;
    other columns are not read; an empty table has no batches."""
    return packing.pack(stage(packing.token_counts(docs), "lengths"))


STAGES = [("language", language), ("near copies", near_copies), ("benchmark passages", benchmark_passages), ("personal data", personal_data), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
