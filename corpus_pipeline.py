"""From raw documents to a training mix: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes
every stage as Parquet in the shared folder and reads it again as the next one's
documents, so a lost executor costs one stage at most. All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, mixing, ngram_jaccard, pii, ranking
from lodestone.llm.store import new_path, removed, table, until_exit


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking accepts; it is fitted on labelled rows outside the held-out fold. A null text is judged like an empty one."""
    return ranking.filter_quality(docs, ranking.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near copies, that of the least id; null and empty texts are one class."""
    return ngram_jaccard.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which fewer than two benchmark items occur; null and empty texts stay."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind and n_chars brought up to date; null texts stay null."""
    return pii.redact(docs, length_col="n_chars")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the number of copies and the words taken; texts without a word are not taken."""
    plan = mixing.mix_sources(docs).where("copies > 0")
    return plan.select("doc_id", "source", "size", F.col("target"), "copies", "taken")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark_leaks", benchmark_leaks), ("personal_data", personal_data), ("mix", mix)]

#: A fitted classifier and MinHash buckets are not SQL; the tests hold the rows against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over ``documents``; an empty table gives none. A stage's table goes when the next one is written, the last with the driver."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            removed(spark, before)
        before = path
    until_exit(spark, path)
    return docs
