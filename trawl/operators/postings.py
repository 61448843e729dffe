"""Trigram postings: optional tables that narrow a search. They stay in long form, one row a pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def postings(rows: DataFrame, column: str) -> DataFrame:
    """tri, path_key of every distinct trigram of a text column."""
    return rows.select("path_key", F.explode(T.trigrams(F.col(column))).alias("tri")).select("tri", "path_key")


def candidates(table: DataFrame, text: str) -> DataFrame:
    """path_keys that hold all trigrams of a text; a text of under three bytes has none and finds nothing."""
    tris = T.trigrams_of(text)
    hit = table.where(F.col("tri").isin(tris) if tris else F.lit(False))
    return hit.groupBy("path_key").agg(F.count_distinct("tri").alias("n")).where(F.col("n") == max(1, len(tris))).select("path_key")


def any_candidates(table: DataFrame, texts: list[str]) -> DataFrame:
    """path_keys of any of several texts."""
    out = candidates(table, texts[0])
    for x in texts[1:]:
        out = out.unionByName(candidates(table, x))
    return out.distinct()


def posting_sizes(table: DataFrame, text: str) -> DataFrame:
    """tri, n: length of each posting of a text; the least bounds the number of candidates."""
    tris = T.trigrams_of(text)
    return table.where(F.col("tri").isin(tris) if tris else F.lit(False)).groupBy("tri").agg(F.count("*").alias("n"))
