"""Queries of the subpackage and, where SQL can express them, their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meterlake.llm import ann, cws, htmltext, langid, minhash, mixing, mixing_sql, negatives, packing, quality, suffixdedup, turnrepair, turnrepair_sql, urlfilter, warc
from meterlake.llm.common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents")).drop("ids")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the passages of 50 words or more that earlier documents hold."""
    return suffixdedup.repeats(table(spark, sf_dir, "documents"))


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written to WARC archives and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all vectors for every vector whose id is divisible by 20."""
    vectors = ann.usable(table(spark, sf_dir, "embeddings"))
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return cws.fingerprints(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on the url of every page."""
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return htmltext.main_texts(table(spark, sf_dir, "pages"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed to the sources' targets."""
    return mixing.mix_summary(table(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents, on sets of two-word shingles."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), n=2)


def op11_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document, from the labels of documents that are not held out."""
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector and its positives."""
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every conversation after damage."""
    return turnrepair.repaired(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_language_id": op2_language_id,
    "op3_repeated_passages": op3_repeated_passages,
    "op4_warc_round_trip": op4_warc_round_trip,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_fingerprints": op6_fingerprints,
    "op7_url_filter": op7_url_filter,
    "op8_main_text": op8_main_text,
    "op9_mix_sources": op9_mix_sources,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_quality_votes": op11_quality_votes,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_turn_repair": op13_turn_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op4_warc_round_trip": warc.ROUND_TRIP_SQL,
    "op5_nearest_neighbours": ann.NEAREST_SQL,
    "op9_mix_sources": mixing_sql.MIX,
    "op10_near_duplicates": minhash.NEAR_SQL,
    "op12_hard_negatives": negatives.NEGATIVES_SQL,
    "op13_turn_repair": turnrepair_sql.REPAIR,
}
