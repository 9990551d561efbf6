"""Whole runs: ingest of configured sources, and the corpus build."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.functions.schema import FEATURES, or_blank, quoted
from chainloom.operators import corpus, tokens
from chainloom.plans import databases as db
from chainloom.plans.formats import BULK, MISC, numbered, paired_layout, parse_layout, placed, recognise, shows_places
from chainloom.sources.delimited import from_path, read_detected, read_fasta
from chainloom.sources.sinks import exists, write_pair, write_splits


@dataclass(frozen=True)
class Config:
    """Paths of sources and of the output; a source without a path is left out."""

    output: str
    hla_fasta: str = ""
    vdjdb: str = ""
    mcpas: str = ""
    tcrdb: str = ""
    assays: dict[str, dict[str, str]] = field(default_factory=dict)
    repositories: dict[str, dict[str, str]] = field(default_factory=dict)

    @classmethod
    def of(cls, tree: dict[str, Any]) -> Config:
        """From the nested mapping of a configuration file."""
        d = tree.get("databases", {})
        return cls(
            output=tree["outputs"]["output_path"],
            hla_fasta=d.get("imgt", {}).get("hla_fasta", ""),
            vdjdb=d.get("vdjdb", ""),
            mcpas=d.get("mcpas_tcr", ""),
            tcrdb=d.get("tcrdb", ""),
            assays={s: d[s] for s in ("cedar", "iedb") if d.get(s)},
            repositories=d.get("ireceptor", {}),
        )


def ingest(spark: SparkSession, config: Config, test: bool = False) -> dict[str, bool]:
    """Writes both tables of every configured source; False for those that were finished before."""
    alleles = read_fasta(spark, config.hla_fasta) if config.hla_fasta else spark.createDataFrame([], "allele string, protein string")
    runs: dict[str, Callable[[], db.Tables]] = {}
    if config.vdjdb:
        runs["vdjdb"] = lambda: db.read_vdjdb(spark, config.vdjdb, alleles, test)
    if config.mcpas:
        runs["mcpas"] = lambda: db.read_mcpas(spark, config.mcpas, alleles, test)
    if config.tcrdb:
        runs["tcrdb"] = lambda: db.read_tcrdb(spark, config.tcrdb, test)
    if config.assays:
        runs["iedb"] = lambda: db.assay_sources(spark, config.assays, alleles, test)
    for name, at in config.repositories.items():
        runs[f"ireceptor_{name}"] = lambda name=name, at=at: db.repository(spark, name, at["database"], at["metadata"], test)
    done = {}
    for label, run in runs.items():
        #: Finished sources aren't even planned.
        done[label] = not exists(spark, f"{config.output}/mri/{label}_mri.parquet") and write_pair(*run(), config.output, label)
    return done


def parse_file(spark: SparkSession, path: str, kind: str, exact: dict[str, set[str]] | None = None, test: bool = False) -> db.Tables:
    """(mri, sequence) of one file of kind bulk, misc or paired, its layout recognised and its origin from its path."""
    df = read_detected(spark, path)
    origin = {k: v for k, v in from_path(path).items() if k != "file_type"}
    file_type = path.rstrip("/").split("/")[-2]
    layout = paired_layout(file_type) if kind == "paired" else recognise(df.columns, BULK if kind == "bulk" else MISC, exact)
    rows = placed(df.select(*map(quoted, layout.required))) if shows_places(layout, df.columns) else numbered(df)
    rows = corpus.sampled(rows) if test else rows
    return parse_layout(rows, layout, origin)


def build_corpus(spark: SparkSession, patterns: list[str], root: str, model: str = "bert", seed: int = 42) -> DataFrame:
    """The exploded corpus by split: distinct features, split by a hash of all of them, then all subsets."""
    df = spark.read.parquet(*patterns)
    rows = df.select(*(or_blank(df, f) for f in FEATURES)).distinct()
    rows = corpus.hash_split(rows.withColumn("_key", F.concat_ws("|", *FEATURES)), "_key", seed)
    out = corpus.power_set(rows, model, keep=["split"])
    write_splits(out, root)
    return spark.read.parquet(root)


def build_token_corpus(spark: SparkSession, patterns: list[str], root: str, length: int = 1024, vocab_size: int = 200, step: int = 1, windowed: bool = True, truncate: bool = True, seed: int = 42) -> dict[str, int]:
    """Tagged, encoded and windowed (or padded) rows by split, with a vocabulary of the training split, saved beside them."""
    df = spark.read.parquet(*patterns)
    rows = df.select(*(or_blank(df, f) for f in FEATURES)).distinct()
    rows = corpus.hash_split(rows.withColumn("_key", F.concat_ws("|", *FEATURES)), "_key", seed)
    text = F.array_join(corpus.tagged(rows), " ")
    rows = rows.withColumn("_text", text).filter("_text <> ''")
    vocab = tokens.vocabulary(rows.filter("split = 'train'"), F.col("_text"), vocab_size)
    ids = tokens.encode(F.col("_text"), tokens.vocabulary_map(vocab), vocab[tokens.UNK])
    coded = rows.withColumn("_ids", ids)
    if windowed:
        coded = coded.withColumn("_w", tokens.windows(F.col("_ids"), length, step))
        coded = coded.withColumn("input_ids", F.col("_w.x")).withColumn("target_ids", F.col("_w.y")).drop("_w")
    else:
        x, y = tokens.shifted(F.col("_ids"), length, truncate=truncate)
        coded = coded.withColumn("input_ids", F.array(x)).withColumn("target_ids", F.array(y))
    write_splits(coded.drop("_key", "_text", "_ids"), root)
    spark.createDataFrame(list(vocab.items()), "word string, id int").coalesce(1).write.mode("overwrite").json(f"{root}_vocabulary")
    return vocab
