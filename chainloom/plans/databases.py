"""Curated databases: each gives (metadata, sequences) as plans over its exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.functions.exprs import digits, first_peptide, no_white, part, prefixed, split_or_none
from chainloom.functions.schema import annotated, or_blank, renamed
from chainloom.operators.corpus import sampled
from chainloom.operators.hla import resolve
from chainloom.operators.pairing import full_outer
from chainloom.sources.delimited import read_delimited, read_repertoires, read_tree

# Source columns and what they are called here.
VDJDB = {
    "cdr3.alpha": "tra", "v.alpha": "trav_gene", "j.alpha": "traj_gene", "cdr3.beta": "trb", "v.beta": "trbv_gene", "d.beta": "trbd_gene", "j.beta": "trbj_gene",
    "species": "host_organism", "mhc.a": "mhc_restriction", "mhc.b": "mhc_restriction_two", "mhc.class": "mhc_class", "antigen.epitope": "peptide",
    "antigen.gene": "epitope_source_molecule", "antigen.species": "epitope_source_organism", "reference.id": "study_id", "method.verification": "assay_method",
    "meta.epitope.id": "epitope_reference_name", "meta.tissue": "source_tissue", "meta.donor.MHC": "mhc_profile",
}
TCRDB = {"RunId": "repertoire_id", "Vregion": "trbv_gene", "Dregion": "trbd_gene", "Jregion": "trbj_gene", "AASeq": "trb"}
MCPAS = {
    "PubMed.ID": "study_id", "Species": "host_organism", "TRAV": "trav_gene", "TRAJ": "traj_gene", "CDR3.alpha.aa": "tra_junction_aa", "TRBV": "trbv_gene",
    "TRBD": "trbd_gene", "TRBJ": "trbj_gene", "CDR3.beta.aa": "trb_junction_aa", "Epitope.peptide": "peptide", "Protein.ID": "epitope_reference_name",
    "Antigen.protein": "epitope_source_molecule", "Pathology": "epitope_source_organism", "MHC": "mhc_restriction", "Antigen.identification.method": "assay_method",
}
ASSAY = [
    "study_id", "epitope_type", "peptide", "epitope_reference_name", "epitope_source_molecule", "epitope_source_organism", "epitope_source_species", "host_organism", "host_population",
    "host_sex", "host_age", "host_mhc_profile", "assay_method", "assay_response", "assay_outcome", "assay_subject_count", "assay_positive_count", "source_tissue", "mhc_restriction",
]
ASSAY_SHORT = [c for c in ASSAY if c not in ("epitope_reference_name", "assay_outcome")]
CHAINS = [
    "chain_one_type", "trav_gene", "trad_gene", "traj_gene", "tra_protein_sequence", "tra_junction_aa", "tra_cdr1", "tra_cdr2",
    "chain_two_type", "trbv_gene", "trbd_gene", "trbj_gene", "trb_protein_sequence", "trb_junction_aa", "trb_cdr1", "trb_cdr2",
]
RECEPTOR = {
    "iedb": ["study_id", "recepetor_reference_name", "receptor_type", "peptide", "epitope_source_molecule", "epitope_source_organism", "assay_method", "mhc_restriction", *CHAINS],
    "cedar": ["recepetor_reference_name", "study_id", "peptide", "epitope_source_molecule", "epitope_source_organism", "assay_method", *CHAINS],
}
LIGAND = {"iedb": ASSAY, "cedar": ASSAY_SHORT}

TCELL_MRI = [
    "data_source", "study_id", "study_id_type", "host_organism", "host_population", "host_age", "host_sex", "host_mhc_profile", "source_tissue", "epitope_type", "peptide",
    "epitope_reference_name", "epitope_source_molecule", "epitope_source_organism", "mhc_restriction", "assay_method", "assay_response", "assay_outcome", "assay_subject_count", "assay_positive_count",
]
LIGAND_MRI = [c for c in TCELL_MRI if c not in ("epitope_reference_name", "assay_outcome")]
RECEPTOR_MRI = [
    "data_source", "study_id", "study_id_type", "host_organism", "trav_gene", "trad_gene", "traj_gene", "tra_junction_aa", "trbv_gene", "trbd_gene", "trbj_gene", "trb_junction_aa",
    "peptide", "epitope_source_molecule", "epitope_source_organism",
]

Tables = tuple[DataFrame, DataFrame]


def vdjdb_tables(df: DataFrame, alleles: DataFrame) -> Tables:
    """Human rows with a score other than 0."""
    rows = renamed(df.filter((F.col("species") == "HomoSapiens") & (F.col("`vdjdb.score`") != "0")), VDJDB)
    seq = rows.select("trav_gene", "traj_gene", "tra", "trbv_gene", "trbd_gene", "trbj_gene", "trb", "peptide", "mhc_restriction", "mhc_restriction_two")
    seq = resolve(seq, alleles, "mhc_restriction", "mhc_one_id", "mhc_one")
    seq = resolve(seq, alleles, "mhc_restriction_two", "mhc_two_id", "mhc_two")
    out = ["trav_gene", "traj_gene", "tra", "trbv_gene", "trbd_gene", "trbj_gene", "trb", "peptide", "mhc_one_id", "mhc_two_id", "mhc_one", "mhc_two"]
    return rows, seq.select(*out, F.lit("vdjdb").alias("source")).distinct()


def tcrdb_tables(df: DataFrame) -> Tables:
    """Cells that say Unknown are blank."""
    rows = df.replace("Unknown", "").select(*(or_blank(df, c).alias(n) for c, n in TCRDB.items()), "study_id")
    rows = rows.replace("Unknown", "")
    return rows, rows.select("trbv_gene", "trbd_gene", "trbj_gene", "trb", F.lit("tcrdb").alias("source")).distinct()


def mcpas_tables(df: DataFrame, alleles: DataFrame, human_only: bool = False) -> Tables:
    """A row for each of an entry's peptides; entries without a peptide keep one row with null."""
    rows = df.select(*(or_blank(df, c).alias(n) for c, n in MCPAS.items()))
    rows = rows.filter(F.col("host_organism") == "Human") if human_only else rows
    mri = annotated(rows, {"data_source": "McPAS-TCR", "study_id_type": "PMID"})
    seq = resolve(rows, alleles, "mhc_restriction", "mhc_id", "mhc_one").withColumn("peptide", F.explode_outer(split_or_none(F.col("peptide"))))
    seq = seq.select("trav_gene", "traj_gene", F.col("tra_junction_aa").alias("tra"), "trbv_gene", "trbd_gene", "trbj_gene", F.col("trb_junction_aa").alias("trb"), "peptide", F.col("mhc_id").alias("mhc_restriction"), "mhc_one", F.lit("McPAS-TCR").alias("source"))
    return mri, seq.distinct()


def assay_tables(df: DataFrame, alleles: DataFrame, source: str, kind: str, first_peptide_only: bool) -> Tables:
    """T-cell and ligand assays: positive ones, where the outcome is told."""
    rows = df.filter(F.col("assay_outcome") == "Positive") if "assay_outcome" in df.columns else df
    rows = annotated(rows, {"data_source": f"{source}_{kind}", "study_id_type": "PMID"})
    mri = rows.select(*(or_blank(rows, c) for c in (TCELL_MRI if kind == "tcell_assay" else LIGAND_MRI)))
    peptide = first_peptide(F.col("peptide")) if first_peptide_only else F.col("peptide")
    seq = rows.select(peptide.alias("peptide"), part(F.col("mhc_restriction"), "/", 1).alias("r1"), part(F.col("mhc_restriction"), "/", 2).alias("r2"))
    seq = resolve(seq, alleles, "r1", "mhc_one_id", "mhc_one")
    seq = resolve(seq, alleles, "r2", "mhc_two_id", "mhc_two")
    return mri, seq.select("peptide", "mhc_one_id", "mhc_one", "mhc_two_id", "mhc_two").distinct()


def receptor_tables(df: DataFrame, source: str) -> Tables:
    """Receptor tables; study ids get the source's name in front, those of the second source being seven digits."""
    study = digits(F.col("study_id"), 7) if source == "cedar" else F.col("study_id")
    rows = df.withColumn("study_id", prefixed(study, source.upper()))
    rows = annotated(rows, {"data_source": f"{source}_receptor_table", "study_id_type": source.upper(), "host_organism": "human"})
    mri = rows.select(*(or_blank(rows, c) for c in RECEPTOR_MRI))
    seq = mri.select("trav_gene", "trad_gene", "traj_gene", F.col("tra_junction_aa").alias("tra"), "trbv_gene", "trbd_gene", "trbj_gene", F.col("trb_junction_aa").alias("trb"), first_peptide(F.col("peptide")).alias("peptide"))
    return mri, seq.distinct()


def union_distinct(tables: list[DataFrame]) -> DataFrame:
    """Union by name, columns that a table lacks being null, without equal rows."""
    return union_all(tables).distinct()


def union_all(tables: list[DataFrame | None]) -> DataFrame:
    """Union by name of the tables that are there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t for t in tables if t is not None])


def assay_source(spark: SparkSession, paths: dict[str, str], alleles: DataFrame, source: str, test: bool = False) -> Tables:
    """The T-cell, receptor and ligand exports of one source, as far as they are configured."""
    take = lambda path, names: (lambda d: sampled(d) if test else d)(read_delimited(spark, path, "\t", names))
    found: list[Tables] = []
    if "tcell_assay" in paths:
        found.append(assay_tables(take(paths["tcell_assay"], ASSAY), alleles, source, "tcell_assay", True))
    if "receptor" in paths:
        found.append(receptor_tables(take(paths["receptor"], RECEPTOR[source]), source))
    if "mhc_ligand" in paths:
        found.append(assay_tables(take(paths["mhc_ligand"], LIGAND[source]), alleles, source, "mhc_ligand_assay", False))
    mri, seq = union_distinct([m for m, _ in found]), union_distinct([s for _, s in found])
    return mri, seq.withColumn("source", F.lit(source))


def assay_sources(spark: SparkSession, config: dict[str, dict[str, str]], alleles: DataFrame, test: bool = False) -> Tables:
    both = [assay_source(spark, config[s], alleles, s, test) for s in ("cedar", "iedb") if config.get(s)]
    return union_distinct([m for m, _ in both]), union_distinct([s for _, s in both])


PAIR_KEYS = ["repertoire_id", "cell_id", "clone_id"]


def chain_side(df: DataFrame, locus: str, side: str, key: str) -> DataFrame:
    names = {"v_call": f"{side}v_gene", "d_call": f"{side}d_gene", "j_call": f"{side}j_gene", "junction_aa": side}
    rows = df.filter(F.col("locus") == locus)
    return rows.select(F.col(key).alias("repertoire_id"), "cell_id", "clone_id", *(F.col(c).alias(n) for c, n in names.items()))


def paired_observations(df: DataFrame, source: str, how: str = "full_outer", key: str = "data_processing_id") -> Tables:
    """Productive alpha and beta rows of a cell and clone side by side; how may be inner, as the older rule has it."""
    rows = df.filter(F.col("productive") == "T")
    alpha, beta = chain_side(rows, "TRA", "tra", key), chain_side(rows, "TRB", "trb", key)
    both = full_outer(alpha, beta, PAIR_KEYS) if how == "full_outer" else alpha.join(beta, PAIR_KEYS, how)
    seq = both.select("trav_gene", "traj_gene", "tra", "trbv_gene", "trbd_gene", "trbj_gene", "trb", F.lit(f"ireceptor_{source}").alias("source")).distinct()
    return both.drop("cell_id", "clone_id"), seq


def both_loci(df: DataFrame, drop_stops: bool = False) -> DataFrame:
    """Productive rows of either locus in one pass over the table, the other chain's columns blank."""
    names = ["repertoire_id", "cell_id", "clone_id", "locus", "v_call", "d_call", "j_call", "junction_aa"]
    rows = df.filter((F.col("productive") == "T") & F.col("locus").isin("TRA", "TRB")).select(*(or_blank(df, c) for c in names))
    rows = rows.filter(~F.col("junction_aa").contains("_")) if drop_stops else rows
    side = lambda locus, c: F.when(F.col("locus") == locus, F.col(c)).otherwise(F.lit(""))
    return rows.select(*PAIR_KEYS, *(side(locus, c).alias(n) for locus, s in (("TRA", "tra"), ("TRB", "trb")) for c, n in (("junction_aa", s), ("v_call", f"{s}v_gene"), ("d_call", f"{s}d_gene"), ("j_call", f"{s}j_gene"))))


def bulk_observations(df: DataFrame, source: str, dedupe: bool = False, drop_stops: bool = False) -> Tables:
    """Observations' ids, and sequences of either chain.

    Sequences are distinct before the alpha D gene is left out, which can leave equal rows; dedupe makes them distinct.
    """
    wide = both_loci(df, drop_stops)
    seq = wide.drop(*PAIR_KEYS).withColumn("source", F.lit(f"ireceptor_{source}")).distinct()
    seq = seq.select("trav_gene", "traj_gene", "tra", "trbv_gene", "trbd_gene", "trbj_gene", "trb", "source")
    return wide.select(*PAIR_KEYS), seq.distinct() if dedupe else seq


#: Repositories, whether they are paired, and what identifies a repertoire there.
REPOSITORIES = {
    "airr_covid": ("paired", "data_processing"),
    "paone": ("bulk", "repertoire_id"),
    "patwo": ("bulk", "repertoire_id"),
    "pathree": ("paired", "data_processing"),
    "umunster": ("bulk", "repertoire_id"),
    "vdjserver": ("bulk", "repertoire_id"),
}
MOST_REPERTOIRES = 500_000


def with_metadata(meta: DataFrame, observations: DataFrame) -> DataFrame:
    """Observations of repertoires that have metadata; metadata is broadcast up to a counted number of rows."""
    small = F.broadcast(meta) if meta.limit(MOST_REPERTOIRES + 1).count() <= MOST_REPERTOIRES else meta
    return small.join(observations, "repertoire_id")


def repository(spark: SparkSession, name: str, database: str, metadata: str, test: bool = False, compat: bool = False) -> Tables:
    """A repository's observations with metadata, and its sequences. compat joins by the processing id everywhere."""
    kind, key = REPOSITORIES[name]
    df = read_delimited(spark, database, "\t")
    df = sampled(df) if test else df
    mri, seq = paired_observations(df, name) if kind == "paired" else bulk_observations(df, name)
    return with_metadata(read_repertoires(spark, metadata, "data_processing" if compat else key), mri), seq


def clean_peptides(df: DataFrame, column: str = "peptide") -> DataFrame:
    """The older rules' filters: no white space, no lower-case letters or digits."""
    return df.withColumn(column, no_white(F.col(column))).filter(~F.col(column).rlike("[a-z0-9]"))


def read_vdjdb(spark: SparkSession, path: str, alleles: DataFrame, test: bool = False) -> Tables:
    df = read_delimited(spark, path, "\t", None)
    return vdjdb_tables(sampled(df) if test else df, alleles)


def read_tcrdb(spark: SparkSession, root: str, test: bool = False) -> Tables:
    df = read_tree(spark, root)
    return tcrdb_tables(sampled(df) if test else df)


def read_mcpas(spark: SparkSession, path: str, alleles: DataFrame, test: bool = False) -> Tables:
    df = read_delimited(spark, path)
    return mcpas_tables(sampled(df) if test else df, alleles)
