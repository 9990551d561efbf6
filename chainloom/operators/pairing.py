"""Pairing of alpha and beta chains: ordered products per cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.functions.exprs import joined_sequence

PARTS = ("cdr3", "v_gene", "d_gene", "j_gene")


def pair_arrays(df: DataFrame, alpha: str, beta: str, keep: list[str]) -> DataFrame:
    """A row for each pair of two arrays' elements: keep, i (from 1; alpha outer, beta inner), a, b.

    If one array is empty the other's elements stand alone, beside null; rows with two empty arrays go.
    """
    some = df.filter((F.size(alpha) > 0) | (F.size(beta) > 0)).withColumn("_nb", F.greatest(F.size(beta), F.lit(1)))
    out = some.select(*keep, "_nb", beta, F.posexplode_outer(alpha).alias("_i", "a"))
    out = out.select(*keep, "_nb", "_i", "a", F.posexplode_outer(beta).alias("_j", "b"))
    return out.select(*keep, (F.coalesce("_i", F.lit(0)) * F.col("_nb") + F.coalesce("_j", F.lit(0)) + 1).alias("i"), "a", "b")


def pair_chains(df: DataFrame, cell: str, order: str, is_alpha: Column, is_beta: Column, parts: tuple[str, str, str, str] = PARTS) -> DataFrame:
    """tid, chains, genes and sequence of every alpha-beta pair of each cell, lists in the given order.

    A row may count as alpha and beta. Chains other than alpha and beta are left out before anything is gathered; a cell
    with an immense number of rows gives that many pairs as well, so it can't be gathered in less.
    """
    each = F.struct(order, *(F.col(p).alias(n) for p, n in zip(parts, PARTS, strict=True)), is_alpha.alias("al"), is_beta.alias("be"))
    cells = df.filter(is_alpha | is_beta).groupBy(F.col(cell).alias("cell")).agg(F.array_sort(F.collect_list(each)).alias("rows"))
    lists = cells.select("cell", F.filter("rows", lambda r: r["al"]).alias("alpha"), F.filter("rows", lambda r: r["be"]).alias("beta"))
    pairs = pair_arrays(lists, "alpha", "beta", ["cell"])
    names = {"a": ("tra", "trav_gene", "trad_gene", "traj_gene"), "b": ("trb", "trbv_gene", "trbd_gene", "trbj_gene")}
    columns = [F.col(f"{side}.{n}").alias(out) for side, outs in names.items() for n, out in zip(PARTS, outs, strict=True)]
    sequence = joined_sequence(F.coalesce(F.col("a.cdr3"), F.lit("")), F.coalesce(F.col("b.cdr3"), F.lit("")))
    return pairs.select(F.concat_ws("_", "cell", "i").alias("tid"), *columns, sequence.alias("sequence"))


def full_outer(alpha: DataFrame, beta: DataFrame, keys: list[str]) -> DataFrame:
    """Alpha and beta rows joined on all keys; blank keys join each other, as values do."""
    return alpha.join(beta, keys, "full_outer")


def inner(alpha: DataFrame, beta: DataFrame, keys: list[str]) -> DataFrame:
    """Alpha and beta rows that have all keys in common."""
    return alpha.join(beta, keys)
