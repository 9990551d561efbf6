"""Scalar expressions: Column in, Column out, no Python on the executors.

Inside the engine the empty string means "empty in the source" and null means "not derivable".
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"  # fixed value: the twenty letters

#: Tokens that stand for a missing value, in the order in which they are replaced.
NULL_TOKENS = ["None", "nan", "NA", "N/A", "na", "NaN"]


def blank(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def contains_any(columns: Sequence[Column], *parts: str) -> Column:
    """Whether any column holds any of the parts. False for nulls."""
    found = F.lit(False)
    for c in columns:
        for p in parts:
            found = found | F.coalesce(c.contains(p), F.lit(False))
    return found


def has_feature(c: Column) -> Column:
    """A string that is there: not null, not empty, not "NA"."""
    return c.isNotNull() & (c != "") & (c != "NA")


def is_protein(c: Column) -> Column:
    """Only letters of amino acids, and at least one; a trailing line feed isn't one."""
    return F.coalesce(c.rlike(rf"^[{AMINO_ACIDS}]+\z"), F.lit(False))


def two_fields(allele: Column) -> Column:
    """An allele name cut to its first two fields: A*01:01:01:06 is A*01:01."""
    return F.array_join(F.slice(F.split(allele, ":"), 1, 2), ":")


def part(c: Column, by: str, i: int) -> Column:
    """The i-th part (from 1) of a split, empty where there are fewer."""
    return F.split_part(c, F.lit(by), F.lit(i))


def first_peptide(c: Column, strip: bool = False) -> Column:
    """Text before the first plus sign; the blank before it stays unless stripped."""
    out = part(c, "+", 1)
    return F.trim(out) if strip else out


def split_or_none(c: Column, by: str = "/") -> Column:
    """Parts of a non-empty string; an empty one has none, so exploding it gives a null row."""
    return F.when(c == "", F.expr("array()").cast("array<string>")).otherwise(F.split(c, by))


def digits(c: Column, n: int) -> Column:
    """The first run of n digits, null where there is none."""
    return F.nullif(F.regexp_extract(c, rf"(\d{{{n}}})", 1), F.lit(""))


def prefixed(c: Column, prefix: str) -> Column:
    """Prefix a value; null and empty pass through."""
    return F.when(c != "", F.concat(F.lit(prefix), c)).otherwise(c)


def chain_entries(c: Column) -> Column:
    """array<struct<chain, seq>> of "TRA:x;TRB:y": pieces without a colon are left out, both sides trimmed."""
    pieces = F.filter(F.split(c, ";"), lambda p: p.contains(":"))
    return F.transform(pieces, lambda p: F.struct(F.upper(F.trim(part(p, ":", 1))).alias("chain"), F.trim(F.substring(p, F.instr(p, ":") + 1, F.length(p))).alias("seq")))


def chain_last(c: Column, chain: str) -> Column:
    """The last sequence of a chain in a chain string; null without one."""
    return F.try_element_at(F.filter(chain_entries(c), lambda e: e["chain"] == chain), F.lit(-1))["seq"]


def chain_all(c: Column, chain: str) -> Column:
    """All sequences of a chain, in order; chain names as they are, no trimming."""
    hits = F.filter(F.split(c, ";"), lambda p: part(p, ":", 1) == chain)
    return F.transform(F.filter(hits, lambda p: p.contains(":")), lambda p: F.substring(p, F.instr(p, ":") + 1, F.length(p)))


def chain_malformed(c: Column) -> Column:
    """Whether a non-empty chain string has a piece without a colon: such rows are set aside."""
    return (c != "") & F.exists(F.split(c, ";"), lambda p: ~p.contains(":"))


def chain_zipped(nt: Column, aa: Column, chain: str) -> Column:
    """Second list's sequences where the first list, piece by piece, names the chain; the shorter list ends both."""
    pairs = F.arrays_zip(F.split(nt, ";").alias("nt"), F.split(aa, ";").alias("aa"))
    pairs = F.filter(pairs, lambda p: p["nt"].isNotNull() & p["aa"].isNotNull() & (part(p["nt"], ":", 1) == chain))
    return F.transform(pairs, lambda p: F.substring(p["aa"], F.instr(p["aa"], ":") + 1, F.length(p["aa"])))


def longest_lower(c: Column) -> Column:
    """The longest run of lower-case letters, the first of equally long ones; empty without any."""
    return F.reduce(F.regexp_extract_all(c, F.lit("([a-z]+)"), F.lit(1)), F.lit(""), lambda a, v: F.when(F.length(v) > F.length(a), v).otherwise(a))


def joined_sequence(tra: Column, trb: Column) -> Column:
    """Non-empty chains with a blank between and a semicolon behind; empty if there is neither."""
    text = F.concat_ws(" ", F.nullif(tra, F.lit("")), F.nullif(trb, F.lit("")))
    return F.when(text == "", F.lit("")).otherwise(F.concat(text, F.lit(";")))


def starless_sequence(columns: Sequence[Column]) -> Column:
    """Join of values that are there and hold no stop sign, with a semicolon behind."""
    return F.concat(F.array_join(F.filter(F.array(*columns), lambda v: v.isNotNull() & ~v.contains("*")), " "), F.lit(";"))


def no_white(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "")


def spaced(c: Column) -> Column:
    """Characters with blanks between: CASS is C A S S."""
    return F.array_join(F.filter(F.split(c, ""), lambda x: x != ""), " ")


def shortened(c: Column, n: int = 50) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def null_tokens(c: Column, compat: bool = False) -> Column:
    """Cells that are a null token become blank; with compat, tokens go from inside of cells too, in their order."""
    if not compat:
        return F.when(c.isin(NULL_TOKENS), F.lit("")).otherwise(c)
    for token in NULL_TOKENS:
        c = F.replace(c, F.lit(token), F.lit(""))
    return c


def json_value(c: Column, *paths: str) -> Column:
    """The value at the first path of a JSON text that has one; empty without any."""
    return F.coalesce(*(F.get_json_object(c, p) for p in paths), F.lit(""))


def argmax(c: Column) -> Column:
    """Place of the first largest element, from 0."""
    return (F.array_position(c, F.array_max(c)) - 1).cast("int")
