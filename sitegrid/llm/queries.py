"""The operators' queries over the whole tables, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import graph_ann, line_dedup, ngram_jaccard, oracles, packing, piece_codec, pii, quality_rules, substring_dedup, toxicity, url_filter
from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger's bits, aggregated: what each rule rejects, rejects alone, and what is kept without it."""
    return quality_rules.ablations(quality_rules.ledger(table(spark, sf_dir, "documents")), quality_rules.FULL)


def op2_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_documents(table(spark, sf_dir, "documents"), with_ids=False)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.summary(table(spark, sf_dir, "documents"))


def op8_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return graph_ann.nearest(rows, rows.where("vec_id % 100 = 0"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.join(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents")).drop("kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [op1_quality_rules, quality_ablations, op2_piece_codec, op3_toxicity, op4_best_fit_packing, op5_url_filters, op6_pii, op7_line_dedup, op8_graph_ann, op9_ngram_jaccard, op10_substring_dedup]
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": oracles.quality_rules(),
        "quality_ablations": oracles.quality_ablations(),
        "op5_url_filters": oracles.url_filter(),
        "op7_line_dedup": oracles.line_dedup(),
        "op9_ngram_jaccard": oracles.ngram_jaccard(),
        "op10_substring_dedup": oracles.substring_dedup(),
    }
