"""Queries of the general data problems: nested records and time intervals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.dewey import dewey_nodes, once
from spanloom.operators.extraction import item_children, item_table
from spanloom.operators.intervals import merge_intervals
from spanloom.session import table


def _envelopes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extractions", "extraction_id", "raw_json")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Mentions, ingredients and brands of every medication of every envelope."""
    rows = item_children(_envelopes(spark, d), "extraction_id", "raw_json")
    return rows.select(F.col("record_id").alias("extraction_id"), F.col("med_ord").cast("int").alias("med_ord"), "child_kind", F.col("child_ord").cast("int").alias("child_ord"), "child_text")


def p1_path_tables(spark: SparkSession, d: str) -> DataFrame:
    """How many nodes each schema path's table holds, and of how many records."""
    whole = once(_envelopes(spark, d), "extraction_id", "raw_json")
    per_record = dewey_nodes(whole, "record_id", "raw").groupBy("path", "record_id").agg(F.count("*").alias("n"))
    return per_record.groupBy("path").agg(F.sum("n").alias("n_nodes"), F.count("*").alias("n_records"))


def p1_items(spark: SparkSession, d: str) -> DataFrame:
    """The item table: one row per medication, keyed by envelope and Dewey label."""
    return item_table(_envelopes(spark, d), "extraction_id", "raw_json").withColumnRenamed("record_id", "extraction_id")


def _child_table(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = item_children(_envelopes(spark, d), "extraction_id", "raw_json").where(F.col("child_kind") == kind)
        return rows.select(F.col("record_id").alias("extraction_id"), "node", F.col("item").alias("parent"), F.col("child_ord").alias("ord"), F.col("child_text").alias("text"))

    run.__doc__ = f"The {kind} table: one row per {kind}; ``parent`` is the label of its item in the item table."
    return run


p1_mentions, p1_ingredients, p1_brands = map(_child_table, ("mention", "ingredient", "brand"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Continuous speech and the gaps in it, from the spans of turns and words."""
    ms = lambda c: F.when(F.abs(F.col(c)) < 1e12, F.round(F.col(c) * 1000)).cast("bigint")
    spans = lambda t: table(spark, d, t, "session_id", "start_s", "end_s").where("end_s > start_s").select("session_id", ms("start_s").alias("lo"), ms("end_s").alias("hi"))
    merged = merge_intervals(spans("turns").unionByName(spans("words")), "session_id", "lo", "hi")
    return merged.select(F.col("entity").alias("session_id"), "kind", F.col("lo").alias("start_ms"), F.col("hi").alias("end_ms"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p1_path_tables": p1_path_tables, "p1_items": p1_items, "p1_mentions": p1_mentions, "p1_ingredients": p1_ingredients, "p1_brands": p1_brands, "p3_found": p3_found}

ORACLES: dict[str, str] = {
    "p3_found": """
        WITH s AS (
            SELECT session_id, CAST(round(start_s * 1000) AS BIGINT) AS lo, CAST(round(end_s * 1000) AS BIGINT) AS hi FROM turns WHERE end_s > start_s
            UNION ALL SELECT session_id, CAST(round(start_s * 1000) AS BIGINT), CAST(round(end_s * 1000) AS BIGINT) FROM words WHERE end_s > start_s),
        v AS (SELECT * FROM s WHERE session_id IS NOT NULL AND hi > lo),
        m AS (SELECT *, max(hi) OVER (PARTITION BY session_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM v),
        g AS (SELECT *, sum(CASE WHEN p IS NULL OR lo > p THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS k FROM m),
        periods AS (SELECT session_id, min(lo) AS start_ms, max(hi) AS end_ms FROM g GROUP BY session_id, k),
        gaps AS (SELECT session_id, lag(end_ms) OVER (PARTITION BY session_id ORDER BY start_ms) AS start_ms, start_ms AS end_ms FROM periods)
        SELECT session_id, 'period' AS kind, start_ms, end_ms FROM periods
        UNION ALL SELECT session_id, 'gap', start_ms, end_ms FROM gaps WHERE start_ms IS NOT NULL""",
}
