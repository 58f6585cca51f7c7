"""Driver queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, filter_audit, mixing, product_codes
from .store import stored, table


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_jaccard import jaccard_classes

    return jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score_toxicity

    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))


def op4_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranking import fit_measures, measures, score_measures

    measured = stored(measures(table(spark, sf_dir, "documents")))
    return score_measures(measured, fit_measures(measured, table(spark, sf_dir, "labels")))


def op5_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_blocks import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .passages import digest, repeated_passages

    return digest(repeated_passages(table(spark, sf_dir, "documents")))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_scan import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_personal_data

    return find_personal_data(table(spark, sf_dir, "documents"))


def op10_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_crf import judge_lines

    return judge_lines(table(spark, sf_dir, "documents")).drop("content_lines")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_piece_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .piece_codes import decode_ids, digest, encode_texts

    return digest(decode_ids(encode_texts(table(spark, sf_dir, "documents"))))


def op13_product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_codes.compress(table(spark, sf_dir, "embeddings")).drop("label")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard, op2_source_mixing, op3_toxicity, op4_quality_ranking, op5_html_blocks, op6_suffix_dedup, op7_decontamination, op8_token_counts, op9_personal_data, op10_line_rules,
        op11_filter_audit, op12_piece_codes, op13_product_codes,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_source_mixing": mixing.SQL.format(docs="documents"),
    "op7_decontamination": decontaminate.SQL.format(docs="documents"),
    "op11_filter_audit": filter_audit.SQL.format(docs="documents", labels="labels"),
    "op13_product_codes": product_codes.SQL.format(vectors="embeddings"),
}
