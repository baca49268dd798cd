"""The registered query of each text operator, with production parameters, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, curves, mixing, packing, pages, periodic, pii, quality, repeats, sketches, toxicity, voronoi, whitening
from .common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.near_duplicates(table(spark, sf_dir, "documents"))


def op3_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi.top_products(table(spark, sf_dir, "embeddings"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.nearest(table(spark, sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents")))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.find_runs(periodic.looped(table(spark, sf_dir, "documents"))))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(table(spark, sf_dir, "embeddings"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing,
        op2_near_duplicates,
        op3_exact_search,
        op4_chat_formatting,
        op5_nearest_neighbours,
        op6_packing,
        op7_html_extraction,
        op8_quality,
        op9_personal_data,
        op10_substring_dedup,
        op11_periodic_runs,
        op12_whitening,
        op13_toxicity,
    )
}
ORACLES = {"op1_mixing": mixing.ORACLE, "op3_exact_search": voronoi.ORACLE, "op4_chat_formatting": chat.ORACLE}
