import pytest

from chainloom.operators import hla

NAMES = ["A*01:01", "A*02:01", "A*02:101", "B*07:02", "DRA*01:01", "DRB1*04:01", "DPB1*01:01", "E*01:03"]

EXPECTED = {
    "HLA-A*02:01": "A*02:01", "HLA-A2": "A*02:01", "A*2:1": "A*02:01", "HLA-A*2": "A*02:01", "A01:01": None, "A*02:10": "A*02:101", "A*02:101": None,
    "C*99": None, "A*02:01:01": None, "HLA-A*02:01 K66A mutant": "A*02:01_mK66A", "HLA-A*02:01 K66A, E163Q mutant": "A*02:01_mK66A_mE163Q",
    "HLA-DRB1*04": "DRB1*04:01", "HLA-DPB1": None, "HLA-E*01:03": None, "HLA-B7": "B*07:02", "": None, "HLA class I": None, None: None,
}


@pytest.fixture(scope="module")
def resolved(spark):
    alleles = spark.createDataFrame([(n, f"M{n}") for n in NAMES], "allele string, protein string")
    df = spark.createDataFrame([(v,) for v in EXPECTED], "v string")
    return {r.v: r for r in hla.resolve(df, alleles, "v", "mhc_id", "mhc").collect()}


@pytest.mark.parametrize("value", list(EXPECTED))
def test_resolution(resolved, value):
    assert resolved[value].mhc_id == EXPECTED[value]


def test_mutants_have_no_protein(resolved):
    assert resolved["HLA-A2"].mhc == "MA*02:01"
    assert resolved["HLA-A*02:01 K66A mutant"].mhc is None


def test_rows_stay(resolved):
    assert len(resolved) == len(EXPECTED)


def test_prefix_lookup_is_an_equi_join(spark):
    alleles = spark.createDataFrame([(n, "") for n in NAMES], "allele string, protein string")
    df = spark.createDataFrame([("HLA-A2",)], "v string")
    plan = hla.resolve(df, alleles, "v", "i", "p")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan
    assert "CartesianProduct" not in plan


def test_restriction_pair(literal):
    from pyspark.sql import functions as F

    pair = hla.restriction_pair(F.col("v"))
    assert literal(*pair, v="DRA*01:01/DRB1*04:01") == ("DRA*01:01", "DRB1*04:01")
    assert literal(*pair, v="DRB1*04:05") == (None, "DRB1*04:05")
    assert literal(*pair, v="A*01:01") == ("A*01:01", None)
    assert literal(*pair, v="A/B") == (None, None)


def test_legacy_names(spark):
    alleles = spark.createDataFrame([("A*02:03",), ("A*02:01:01",)], "allele string")
    given = {"HLA-A2": "A*02:01:01", "HLA-B7": "B*07:01", "HLA-B*7:2": "B*7:2", "HLA-DPB1": "DPB1*01:01", "HLA-DRB1*03": "DRB1*03:01", "HLA-DQA1*5:1": "DQA1*5:1", "HLA-E*01:03": "E*01:03", "B*7:2": "B*7:2", "HLA-A": "HLA-A", None: None}
    df = spark.createDataFrame([(v,) for v in given], "v string")
    assert {r.v: r.name for r in hla.legacy_resolve(df, alleles, "v", "name").collect()} == given
