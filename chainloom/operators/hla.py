"""Allele names and proteins: normalising, prefix look-up and translation by joins with a small reference table.

The prefix look-up (the first allele in code-point order that starts with a value) would be a nested loop over values
and alleles as a join condition. Instead every prefix of every allele is listed once with its least allele, so that the
look-up is an equi-join; the list has a row for each distinct prefix, some ten thousand times a dozen rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Forms of a valid allele.
VALID = [
    r"^[ABC]\*\d{2}(:\d{2}){0,3}$",
    r"^DR[AB][1345]?\*\d{2}(:\d{2}){0,2}$",
    r"^D[PQ][AB][12]?\*\d{2}(:\d{2}){0,2}$",
]
#: Fixed value: the mark of a mutant.
MUTANT = r"\s+([A-Za-z0-9, ]+)\s+mutant$"
MOST_ALLELES = 200_000  # rows of a reference table that is broadcast; longer ones are joined by shuffle
BETA = ["DRB", "DPB", "DQB"]


def sized(df: DataFrame, most: int = MOST_ALLELES) -> DataFrame:
    """Broadcast a reference table of at most so many rows, counted; otherwise leave the join to the optimiser."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def mutations(c: Column) -> Column:
    """"_mK66A_mE163Q" for "... K66A, E163Q mutant", empty otherwise."""
    listed = F.regexp_extract(c, MUTANT, 1)
    return F.when(listed == "", F.lit("")).otherwise(F.concat(F.lit("_"), F.array_join(F.transform(F.split(listed, ","), lambda a: F.concat(F.lit("m"), F.trim(a))), "_")))


def normalised(c: Column) -> Column:
    """The allele's name in standard form; forms without a rule pass unchanged."""
    base = F.trim(F.regexp_replace(c, MUTANT, ""))
    base = F.when(base.startswith("HLA-"), F.replace(base, F.lit("HLA-"), F.lit(""))).otherwise(base)
    base = F.replace(base, F.lit("-"), F.lit(":"))
    short = F.regexp_replace(F.regexp_replace(base, r"^([ABC])(\d{1,2})$", "$1*$2"), r"([ABC])\*(\d)$", "$1*0$2")
    full = F.regexp_replace(F.regexp_replace(base, r"([ABC])\*(\d):(\d{1,2})$", "$1*0$2:$3"), r"([ABC])\*(\d{2}):(\d)$", "$1*$2:0$3")
    return F.when(base.rlike(r"^[ABC]\*?\d{1,2}$"), short).when(base.rlike(r"^[ABC]\*?\d{1,2}:\d{1,2}$"), full).otherwise(base)


def lookup_key(c: Column) -> Column:
    """The name to look up; null for blank values and invalid names."""
    name = normalised(c)
    return F.when((F.trim(c) != "") & name.rlike("|".join(f"(?:{v})" for v in VALID)), name)


def prefixes(alleles: DataFrame) -> DataFrame:
    """prefix, first_allele: the least allele with each prefix. alleles: allele, protein."""
    each = alleles.select("allele", F.explode(F.transform(F.sequence(F.lit(1), F.length("allele")), lambda n: F.left("allele", n))).alias("prefix"))
    return each.groupBy("prefix").agg(F.min("allele").alias("first_allele"))


def resolve(df: DataFrame, alleles: DataFrame, column: str, id_out: str, protein_out: str) -> DataFrame:
    """Adds the resolved allele of a column, with its mutations, and the protein of the allele.

    Proteins are looked up by the text before the first semicolon, mutations included, so mutants have none.
    """
    first = sized(prefixes(alleles)).alias("p")
    protein = sized(alleles.select(F.col("allele").alias("_allele"), F.col("protein").alias(protein_out)))
    named = df.withColumn("_key", lookup_key(F.col(column))).join(first, F.col("_key") == F.col("p.prefix"), "left").drop("prefix")
    named = named.withColumn(id_out, F.concat(F.col("first_allele"), mutations(F.col(column)))).drop("_key", "first_allele")
    return named.join(protein, F.split_part(F.col(id_out), F.lit(";"), F.lit(1)) == F.col("_allele"), "left").drop("_allele")


def restriction_pair(c: Column) -> tuple[Column, Column]:
    """(alpha, beta) of a restriction: both sides of a slash if the second is a beta chain, else the side that it is."""
    beta = lambda x: F.exists(F.array(*map(F.lit, BETA)), lambda p: x.contains(p))
    both, left, right = c.contains("/"), F.split_part(c, F.lit("/"), F.lit(1)), F.split_part(c, F.lit("/"), F.lit(2))
    return (
        F.when(both & beta(right), left).when(~both & ~beta(c), c),
        F.when(both & beta(right), right).when(~both & beta(c), c),
    )


#: Forms of names that the older rules know, and what becomes of each.
LEGACY = [
    (r"^HLA-([ABC]\*\d+:\d+)$", "$1"),
    (r"^HLA-(D[PQ][AB][12]?\*\d+:\d+)$", "$1"),
    (r"^HLA-(DR[AB][1345]?\*\d+:\d+)$", "$1"),
    (r"^HLA-(DR[AB][1345]?\*\d+)$", "$1:01"),
    (r"^HLA-(D[PQ][AB][12]?)$", "$1*01:01"),
    (r"^HLA-(E\*\d+:\d+)$", "$1"),
]
LEGACY_SHORT = r"^HLA-([ABC])(\d{1,2})$"


def legacy_normalised(c: Column) -> Column:
    """Names by the older rules, but for short class I names, which are looked up; other forms and null pass unchanged."""
    out = c
    for form, name in reversed(LEGACY):
        out = F.when(c.rlike(form), F.regexp_replace(c, form, name)).otherwise(out)
    return out


def legacy_resolve(df: DataFrame, alleles: DataFrame, column: str, out: str) -> DataFrame:
    """Adds names by the older rules: a short class I name is the first allele of its two digits, or their field 01."""
    c = F.col(column)
    digits = F.lpad(F.regexp_extract(c, LEGACY_SHORT, 2), 2, "0")
    key = F.when(c.rlike(LEGACY_SHORT), F.concat(F.regexp_extract(c, LEGACY_SHORT, 1), F.lit("*"), digits))
    first = sized(prefixes(alleles))
    found = df.withColumn("_key", key).join(first, F.col("_key") == F.col("prefix"), "left")
    name = F.when(F.col("_key").isNotNull(), F.coalesce("first_allele", F.concat("_key", F.lit(":01")))).otherwise(legacy_normalised(c))
    return found.withColumn(out, name).drop("_key", "prefix", "first_allele")
