"""Corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.functions.exprs import shortened


def combo_counts(df: DataFrame, feats: str = "combo_feats", by: list[str] | None = None) -> DataFrame:
    """Rows of each feature combination, whatever the order of its features, the most frequent first."""
    key = F.array_join(F.array_sort(feats), "_").alias("combo")
    out = df.groupBy(*(by or []), key).agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(*(by or []), F.desc("n"), "combo")


def token_totals(df: DataFrame, ids: str = "input_ids", by: str = "split") -> DataFrame:
    """Rows and tokens of each split, in one pass."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.size(ids).cast("long")).alias("n_tokens"))


def report(df: DataFrame, text: str, feats: str, by: str = "split") -> DataFrame:
    """Combination counts of each split with one shortened example."""
    key = F.array_join(F.array_sort(feats), "_").alias("combo")
    return df.groupBy(by, key).agg(F.count(F.lit(1)).alias("n"), shortened(F.min(text)).alias("example")).orderBy(by, F.desc("n"), "combo")
