"""Parquet sinks and the manifest of finished outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished write is there: its success marker."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Snappy Parquet; the committer merges all tasks' files."""
    df.write.mode(mode).option("compression", "snappy").parquet(path)


def write_pair(mri: DataFrame, seq: DataFrame, root: str, label: str) -> bool:
    """Both tables of a source, unless they are finished; the MRI table is written last and stands for both.

    Tables without rows aren't written. Whether anything was.
    """
    spark = mri.sparkSession
    if exists(spark, f"{root}/mri/{label}_mri.parquet"):
        return False
    some = False
    for kind, df in (("seq", seq), ("mri", mri)):
        if not df.isEmpty():
            write_table(df, f"{root}/{kind}/{label}_{kind}.parquet")
            some = True
    return some


def write_splits(df: DataFrame, root: str, mode: str = "overwrite") -> None:
    """A corpus by split, each in a folder of its own."""
    df.write.mode(mode).option("compression", "snappy").partitionBy("split").parquet(root)
