"""Canonical tables: column names in order, and the projection that brings any table into that shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The two canonical column orders.
SEQUENCE = ["source", "tid", "tra", "trad_gene", "traj_gene", "trav_gene", "trb", "trbd_gene", "trbj_gene", "trbv_gene", "peptide", "mhc_one", "mhc_two"]
MRI = ["tid", "tra", "trad_gene", "traj_gene", "trav_gene", "trb", "trbd_gene", "trbj_gene", "trbv_gene", "peptide", "mhc_one", "mhc_two", "sequence", "repertoire_id", "study_id", "category", "molecule_type", "host_organism", "source"]

#: Features of the corpus, in the order in which subsets list them.
FEATURES = ["tra", "trb", "peptide", "mhc_one", "mhc_two"]


def strings(names: list[str]) -> T.StructType:
    """A schema of nullable strings."""
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def empty(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame([], strings(names))


def quoted(name: str) -> Column:
    """A column whose name may hold dots or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def or_blank(df: DataFrame, name: str) -> Column:
    """A column as a string, or the empty string where the table has none."""
    return quoted(name).cast("string").alias(name) if name in df.columns else F.lit("").alias(name)


def canonical(df: DataFrame, names: list[str]) -> DataFrame:
    """Missing columns are blank, others are dropped, nulls become blank, everything is a string: one projection."""
    return df.select(*(F.coalesce(or_blank(df, n), F.lit("")).alias(n) for n in names))


def to_sequence(df: DataFrame) -> DataFrame:
    return canonical(df, SEQUENCE)


def to_mri(df: DataFrame) -> DataFrame:
    return canonical(df, MRI)


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Select and rename by an ordered map; names may hold dots."""
    return df.select(*(quoted(old).alias(new) for old, new in names.items()))


def annotated(df: DataFrame, values: dict[str, str | Column]) -> DataFrame:
    """Constant columns, replacing those of the same name."""
    return df.withColumns({k: v if isinstance(v, Column) else F.lit(v) for k, v in values.items()})
