import pytest
from pyspark.sql import functions as F

from chainloom.functions import exprs as x

c = F.col


@pytest.mark.parametrize(
    ("value", "expected"),
    [("CASSF", True), ("", False), ("CASS\n", False), ("CASZ", False), ("cass", False), (None, False)],
)
def test_is_protein(literal, value, expected):
    assert literal(x.is_protein(c("v")), v=value) is expected


def test_feature_presence(literal):
    assert [literal(F.coalesce(x.has_feature(c("v")), F.lit(False)), v=v) for v in ("A", "", "NA", None)] == [True, False, False, False]


def test_two_fields(literal):
    assert literal(x.two_fields(c("v")), v="A*01:01:01:06") == "A*01:01"
    assert literal(x.two_fields(c("v")), v="A*01") == "A*01"


def test_chain_strings(literal):
    text = "TRA:CA1;TRB:CB1; tra : CA2 ;junk"
    assert literal(x.chain_last(c("v"), "TRA"), x.chain_last(c("v"), "TRB"), v=text) == ("CA2", "CB1")
    assert literal(x.chain_all(c("v"), "TRA"), v="TRA:CA1;TRB:CB1;TRA:CA2") == ["CA1", "CA2"]
    assert literal(x.chain_last(c("v"), "TRA"), v="") is None
    assert literal(x.chain_malformed(c("v")), x.chain_malformed(F.lit("TRA:x")), x.chain_malformed(F.lit("")), v=text) == (True, False, False)


def test_chain_zip_stops_at_the_shorter_list(literal):
    assert literal(x.chain_zipped(c("n"), c("a"), "TRA"), n="TRA:nt1;TRB:nt2;TRA:nt3", a="TRA:CA1;TRB:CB1") == ["CA1"]


@pytest.mark.parametrize(("value", "expected"), [("ABcdEfghIjk", "fgh"), ("ABab12cd", "ab"), ("ABC", ""), ("", "")])
def test_longest_lower_is_the_first_of_equals(literal, value, expected):
    assert literal(x.longest_lower(c("v")), v=value) == expected


def test_split_or_none(spark):
    df = spark.createDataFrame([("a/b",), ("",), ("a//b",)], "v string")
    assert [r.p for r in df.select(F.explode_outer(x.split_or_none(c("v"))).alias("p")).collect()] == ["a", "b", None, "a", "", "b"]


def test_digits_and_prefix(literal):
    assert literal(x.prefixed(x.digits(c("v"), 7), "CEDAR"), v="id 1234567 x") == "CEDAR1234567"
    assert literal(x.prefixed(x.digits(c("v"), 7), "CEDAR"), v="123") is None
    assert literal(x.prefixed(c("v"), "IEDB"), v="") == ""


def test_peptides(literal):
    assert literal(x.first_peptide(c("v")), x.first_peptide(c("v"), strip=True), v="GIL + OX(M1)") == ("GIL ", "GIL")


def test_sequences(literal):
    assert literal(x.joined_sequence(c("a"), c("b")), a="CA", b="CB") == "CA CB;"
    assert literal(x.joined_sequence(c("a"), c("b")), a="", b="CB") == "CB;"
    assert literal(x.joined_sequence(c("a"), c("b")), a="", b="") == ""
    assert literal(x.starless_sequence([c("a"), c("b"), F.lit(None).cast("string")]), a="C*A", b="CB") == "CB;"


@pytest.mark.parametrize(
    ("value", "compat", "expected"),
    [("ARNADE", True, "ARDE"), ("CANAL", True, "CAL"), ("DNA", True, "D"), ("NA", True, ""), ("nan", True, ""), ("None", True, ""), ("ARNADE", False, "ARNADE"), ("CANAL", False, "CANAL"), ("DNA", False, "DNA"), ("NA", False, ""), ("N/A", False, "")],
)
def test_null_tokens(literal, value, compat, expected):
    assert literal(x.null_tokens(c("v"), compat), v=value) == expected


def test_small_ones(literal):
    assert literal(x.spaced(c("v")), x.no_white(c("w")), x.shortened(c("l"), 3), v="CASS", w=" a b\tc", l="abcd") == ("C A S S", "abc", "abc...")
    assert literal(x.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0)))) == 1
    assert literal(x.contains_any([c("a"), c("b")], "TRA"), x.contains_any([c("b")], "TRA"), a="xTRAV", b=None) == (True, False)
