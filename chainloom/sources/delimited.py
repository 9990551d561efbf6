"""Delimited, FASTA, JSON and Parquet sources. Every field is a string; an empty field is the empty string, not null."""

from __future__ import annotations

import csv
import json
from collections import defaultdict

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainloom.functions.exprs import two_fields
from chainloom.functions.schema import empty, quoted

PEEK = 20_000  # characters of a file that its delimiter is guessed from
MITCR = "MiTCRFullExportV1.1"  # fixed value: marks exports whose first line isn't the header
BLOCK = 64 << 20


def filled(df: DataFrame) -> DataFrame:
    """Null strings become empty: readers give null for an empty field, which would neither join nor compare."""
    return df.na.fill("")


def head(spark: SparkSession, path: str, chars: int = PEEK) -> str:
    """The first characters of a file on any store Spark reads."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, 4 * chars))).decode("utf-8", "replace")[:chars]
    finally:
        stream.close()


def sniff(sample: str, path: str = "") -> tuple[str, int]:
    """(delimiter, lines to skip) from a sample, overridden by the extensions .tsv and .csv."""
    if MITCR in sample:
        return "\t", 1
    if path.endswith(".tsv"):
        return "\t", 0
    try:
        found = csv.Sniffer().sniff(sample).delimiter
    except csv.Error:
        found = ""
    if not found or found.isalnum():  # nothing, or a letter that is merely frequent
        found = "\t" if "\t" in sample else ","
    if found in "\t,":
        return found, 0
    if path.endswith(".csv"):
        return ",", 0
    raise ValueError(f"{path or 'the sample'} is delimited by {found!r}; only tab and comma are read")


def read_delimited(spark: SparkSession, path: str | list[str], sep: str = ",", names: list[str] | None = None, skip: int = 0, path_columns: bool = False) -> DataFrame:
    """All-string rows of delimited files with a header.

    names rename the columns by position; a file of another width is an error. skip drops physical lines before the
    header. A path that doesn't exist gives an empty table of names. The scan is lazy and splits large files, except
    with skip, which reads whole files.
    """
    try:
        if skip:
            return _skipping(spark, path, sep, names, skip)
        df = spark.read.options(sep=sep, header=True, quote='"', escape='"', enforceSchema=False).csv(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return empty(spark, names or [])
        raise
    if path_columns:
        df = df.withColumns(from_path())
    if names is not None:
        got = len(df.columns) - (len(PATH_PARTS) if path_columns else 0)
        if got != len(names):
            raise ValueError(f"{path} has {got} columns, not {len(names)}")
        df = df.toDF(*names, *(PATH_PARTS if path_columns else []))
    return filled(df)


def _skipping(spark: SparkSession, path: str | list[str], sep: str, names: list[str] | None, skip: int) -> DataFrame:
    """Files whose first lines aren't the header; they are split into lines and parsed as a whole."""
    whole = spark.read.text(path, wholetext=True).select(F.slice(F.split("value", "\r?\n"), F.lit(skip + 1), F.lit(2**31 - 2 - skip)).alias("lines"))
    first = whole.select(F.get("lines", F.lit(0))).first()[0]
    header = next(csv.reader([first], delimiter=sep))
    rows = whole.select(F.explode(F.slice("lines", 2, 2**31 - 3)).alias("line")).filter("line <> ''")
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header))])
    parsed = rows.select(F.from_csv("line", schema.simpleString()[7:-1].replace(":", " "), {"sep": sep, "quote": '"', "escape": '"'}).alias("r")).select("r.*")
    return filled(parsed.toDF(*(names or header)))


PATH_PARTS = ["repertoire_id", "file_type", "molecule_type", "study_id", "category"]


def from_path(path: str | None = None) -> dict[str, F.Column]:
    """Columns from the path .../category/study/molecule/file_type/repertoire.ext of the row's file, or of a given one."""
    parts = F.split(F.col("_metadata.file_path") if path is None else F.lit(path), "/")
    up = lambda k: F.coalesce(F.try_element_at(parts, F.lit(-k)), F.lit(""))
    stem = F.regexp_replace(up(1), r"\.[^.]*$", "")
    return dict(zip(PATH_PARTS, [stem, up(2), up(3), up(4), up(5)], strict=True))


def read_detected(spark: SparkSession, path: str) -> DataFrame:
    """A file whose delimiter is guessed from its head."""
    sep, skip = sniff(head(spark, path), path)
    return read_delimited(spark, path, sep, skip=skip)


def list_files(spark: SparkSession, root: str, suffix: str) -> list[str]:
    """Files under a folder, in order of their names."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(root).select("path")
    return sorted(r["path"] for r in found.collect())


def read_tree(spark: SparkSession, root: str, sep: str = "\t", suffix: str = ".tsv") -> DataFrame:
    """All files under a folder, with the file's stem as study_id.

    Files are grouped by their header lines, so that each group of equal headers is one scan whatever the number of its
    files; columns are matched by name.
    """
    try:
        paths = list_files(spark, root, suffix)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return empty(spark, ["study_id"])
        raise
    groups: dict[str, list[str]] = defaultdict(list)
    for p in paths:
        groups[head(spark, p, 4000).split("\n", 1)[0].rstrip("\r")].append(p)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    out: DataFrame | None = None
    for members in groups.values():
        one = filled(spark.read.options(sep=sep, header=True, quote='"', escape='"').csv(members).withColumn("study_id", F.url_decode(F.replace(stem, F.lit("+"), F.lit("%2B")))))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return empty(spark, ["study_id"]) if out is None else filled(out)


def read_fasta(spark: SparkSession, path: str, pattern: str = "*_prot.fasta") -> DataFrame:
    """allele (two fields), protein: the first record of each allele, files by name, records by place.

    Records split at ">", so files split like text and lines are joined within a record.
    """
    text = spark.read.option("pathGlobFilter", pattern).text(path, lineSep=">")
    rows = text.select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    lines = F.split(F.col("value"), "\r?\n")
    allele = two_fields(F.get(F.split(F.trim(F.get(lines, F.lit(0))), r"\s+"), F.lit(1)))
    protein = F.array_join(F.transform(F.slice(lines, 2, 2**31 - 3), lambda x: F.trim(x)), "")
    named = rows.filter(F.trim("value") != "").select(allele.alias("allele"), protein.alias("protein"), F.struct("file", "block", "place").alias("at")).filter("allele IS NOT NULL")
    return named.groupBy("allele").agg(F.min_by("protein", "at").alias("protein"))


ALLELES = "array<struct<mhc_alleles:array<struct<allele_designation:string>>>>"
REPERTOIRE = f"""Repertoire array<struct<repertoire_id:string,study:struct<study_id:string>,
data_processing:array<struct<data_processing_id:string>>,
subject:struct<age:string,sex:string,race:string,species:struct<label:string>,
diagnosis:array<struct<study_group_description:string,disease_diagnosis:struct<label:string>>>,
genotype:struct<mhc_genotype_set:struct<mhc_genotype_list:{ALLELES}>>>,
sample:array<struct<tissue:struct<label:string>>>>>"""


def read_repertoires(spark: SparkSession, path: str | list[str], id_from: str = "data_processing") -> DataFrame:
    """Distinct metadata rows of repertoire documents.

    id_from names what identifies a repertoire: its first data_processing, or its own repertoire_id. A record without a
    study, or with a disease but no group description, is left out, as a broken one.
    """
    r = spark.read.option("multiLine", True).schema(REPERTOIRE.replace("\n", "")).json(path).select(F.explode("Repertoire").alias("r"))
    return repertoire_rows(r, id_from)


def repertoire_rows(r: DataFrame, id_from: str = "data_processing") -> DataFrame:
    blank = lambda c: F.coalesce(c, F.lit(""))
    s = F.col("r.subject")
    has_diagnosis = s["diagnosis"].isNotNull()
    first = F.get(s["diagnosis"], F.lit(0))
    group, disease = first["study_group_description"], blank(first["disease_diagnosis"]["label"])
    broken = F.col("r.study.study_id").isNull() | (has_diagnosis & group.isNull() & (disease != ""))
    own = F.col("r.repertoire_id") if id_from == "repertoire_id" else F.get(F.col("r.data_processing"), F.lit(0))["data_processing_id"]
    listed = F.flatten(F.transform(F.coalesce(s["genotype"]["mhc_genotype_set"]["mhc_genotype_list"], F.expr("array()").cast(ALLELES)), lambda g: F.transform(F.coalesce(g["mhc_alleles"], F.expr("array()").cast("array<struct<allele_designation:string>>")), lambda a: a["allele_designation"])))
    profile = F.array_join(F.array_sort(F.array_distinct(F.filter(listed, lambda a: a.isNotNull() & (a != "")))), ",")
    return (
        r.filter(~broken)
        .select(
            F.col("r.study.study_id").alias("study_id"),
            blank(own).alias("repertoire_id"),
            blank(s["species"]["label"]).alias("host_organism"),
            F.when(disease != "", F.concat(blank(group), F.lit(" "), disease)).otherwise(blank(group)).alias("condition_studies"),
            blank(s["age"]).alias("age"),
            blank(s["sex"]).alias("sex"),
            blank(s["race"]).alias("population_surveyed"),
            blank(F.get(F.col("r.sample"), F.lit(0))["tissue"]["label"]).alias("source_tissue"),
            blank(profile).alias("mhc_profile"),
        )
        .distinct()
    )


def read_parquet(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """Parquet from any store, by globs."""
    return spark.read.parquet(*patterns)


def read_splits(spark: SparkSession, root: str, split: str | None = None) -> DataFrame:
    """A saved corpus; a split reads its own folders only."""
    df = spark.read.parquet(root)
    return df if split is None else df.filter(F.col("split") == split)


def read_rules(path: str) -> list[dict]:
    """The masking rules of a JSON file."""
    with open(path) as f:
        return json.load(f)["masking_rules"]


def read_limited(df: DataFrame, rows: int | None) -> DataFrame:
    """A limited scan; without an order, which rows come is open."""
    return df if rows is None else df.limit(rows)


def select_text(df: DataFrame, drop: list[str]) -> DataFrame:
    """Without columns of these names, whether or not the table has them."""
    return df.select(*(quoted(c) for c in df.columns if c not in set(drop)))


def read_config(path: str) -> dict:
    """A configuration file: JSON, or YAML where a YAML library is installed."""
    with open(path) as f:
        text = f.read()
    try:
        return json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError(f"{path} isn't JSON, and no YAML library is installed") from e
        return yaml.safe_load(text)
