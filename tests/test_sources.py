import json

import pytest
from pyspark.sql import functions as F

from chainloom.plans import databases as db
from chainloom.plans import pipeline
from chainloom.sources import delimited as s
from chainloom.sources import sinks
from chainloom.streaming.landing import follow


def tsv(path, *rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join("\t".join(r) + "\n" for r in rows))
    return str(path)


def rows(df, *names):
    return sorted(tuple(r[n] for n in names or df.columns) for r in df.collect())


def test_empty_fields_stay_empty_strings(spark, tmp_path):
    path = tsv(tmp_path / "a.tsv", ("x", "y"), ("1", ""), ("", "2"))
    assert rows(s.read_delimited(spark, path, "\t")) == [("", "2"), ("1", "")]


def test_quotes_in_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n"a,b","say ""hi"""\n')
    assert rows(s.read_delimited(spark, str(tmp_path / "a.csv"))) == [("a,b", 'say "hi"')]


def test_positional_names(spark, tmp_path):
    path = tsv(tmp_path / "a.tsv", ("A A", "A A"), ("1", "2"))
    assert s.read_delimited(spark, path, "\t", ["p", "q"]).columns == ["p", "q"]
    with pytest.raises(ValueError, match="2 columns, not 1"):
        s.read_delimited(spark, path, "\t", ["p"])


def test_missing_file_is_empty(spark, tmp_path):
    df = s.read_delimited(spark, str(tmp_path / "no.tsv"), "\t", ["a", "b"])
    assert (df.columns, df.count()) == (["a", "b"], 0)


@pytest.mark.parametrize(
    ("sample", "path", "expected"),
    [("a\tb\n1\t2\n", "x.txt", ("\t", 0)), ("a,b\n1,2\n", "x.txt", (",", 0)), ("MiTCRFullExportV1.1\nx", "x.txt", ("\t", 1)), ("a;b\n1;2\n", "x.csv", (",", 0)), ("a,b\n1,2\n", "x.tsv", ("\t", 0)), ("ab", "x", (",", 0))],
)
def test_sniffing(sample, path, expected):
    assert s.sniff(sample, path) == expected


def test_sniffing_another_delimiter_is_an_error():
    with pytest.raises(ValueError, match="only tab and comma"):
        s.sniff("a;b\n1;2\n3;4\n", "x.txt")


def test_tree_with_other_column_orders(spark, tmp_path):
    tsv(tmp_path / "t" / "S1.tsv", ("RunId", "Vregion", "AASeq"), ("r1", "Unknown", "CA"))
    tsv(tmp_path / "t" / "sub" / "S2.tsv", ("AASeq", "RunId", "Dregion"), ("CB", "r2", "D"))
    df = s.read_tree(spark, str(tmp_path / "t"))
    mri, seq = db.tcrdb_tables(df)
    assert rows(mri, "study_id", "repertoire_id", "trbv_gene", "trbd_gene", "trb") == [("S1", "r1", "", "", "CA"), ("S2", "r2", "", "D", "CB")]
    assert rows(seq, "trb", "source") == [("CA", "tcrdb"), ("CB", "tcrdb")]


def test_fasta_first_record_wins(spark, tmp_path):
    (tmp_path / "A_prot.fasta").write_text(">HLA:1 A*01:01:01:01 365 bp\nMAV\nMAP\n>HLA:2 A*01:01:01:02 365 bp\nXXX\n>HLA:3 A*02:01:01:01 365 bp\nMQQ\n")
    (tmp_path / "B_prot.fasta").write_text(">HLA:9 A*02:01 1 bp\nZZZ\n>HLA:8 B*07:02 1 bp\nMB\n")
    (tmp_path / "other.fasta").write_text(">HLA:9 C*01:01 1 bp\nZZZ\n")
    assert rows(s.read_fasta(spark, str(tmp_path)), "allele", "protein") == [("A*01:01", "MAVMAP"), ("A*02:01", "MQQ"), ("B*07:02", "MB")]


def repertoire(**subject):
    return {"repertoire_id": 7, "study": {"study_id": "S"}, "data_processing": [{"data_processing_id": "dp"}], "subject": {"age": "3", **subject}, "sample": [{"tissue": {"label": "blood"}}]}


def test_repertoires(spark, tmp_path):
    allele = lambda *names: {"mhc_genotype_set": {"mhc_genotype_list": [{"mhc_alleles": [{"allele_designation": n} for n in names]}]}}
    docs = [
        repertoire(genotype=allele("B", "A", "B", None)),
        repertoire(diagnosis=[{"study_group_description": "g", "disease_diagnosis": {"label": "ill"}}]),
        repertoire(diagnosis=[{"study_group_description": None, "disease_diagnosis": {"label": "ill"}}]),
        repertoire(age="4"),
        repertoire(age="4"),
    ]
    (tmp_path / "m.json").write_text(json.dumps({"Info": {}, "Repertoire": docs}))
    got = s.read_repertoires(spark, str(tmp_path / "m.json"))
    assert rows(got, "age", "condition_studies", "mhc_profile", "source_tissue", "repertoire_id") == [("3", "", "A,B", "blood", "dp"), ("3", "g ill", "", "blood", "dp"), ("4", "", "", "blood", "dp")]
    assert {r.repertoire_id for r in s.read_repertoires(spark, str(tmp_path / "m.json"), "repertoire_id").collect()} == {"7"}


def test_path_columns(spark, tmp_path):
    path = tmp_path / "cat" / "st" / "mol" / "contigs" / "rep.csv"
    tsv(path, ("a", "b"))
    path.write_text("a,b\n1,2\n")
    df = s.read_delimited(spark, str(path), path_columns=True)
    assert rows(df, *s.PATH_PARTS) == [("rep", "contigs", "mol", "st", "cat")]


def test_rules_and_small_scans(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"masking_rules": [{"if_combo_feats": ["tra"], "action": "mask_all", "params": {}}]}')
    assert s.read_rules(str(tmp_path / "r.json"))[0]["action"] == "mask_all"
    assert s.read_limited(spark.range(10), 3).count() == 3
    assert s.read_limited(spark.range(10), None).count() == 10
    assert s.select_text(spark.range(1).withColumn("a.b", F.lit(1)), ["id", "zz"]).columns == ["a.b"]


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"a": {"b": 1}}')
    (tmp_path / "c.txt").write_text("a: [")
    assert s.read_config(str(tmp_path / "c.json")) == {"a": {"b": 1}}
    with pytest.raises(Exception, match=r"JSON|expected"):
        s.read_config(str(tmp_path / "c.txt"))


ALLELES = [("A*02:01", "MA"), ("B*07:02", "MB"), ("DRB1*04:01", "MD")]


@pytest.fixture
def alleles(spark):
    return spark.createDataFrame(ALLELES, "allele string, protein string")


def test_vdjdb(spark, tmp_path, alleles):
    names = [*db.VDJDB, "vdjdb.score"]
    row = lambda **v: tuple(v.get(n.replace(".", "_"), "") for n in names)
    base = {"cdr3_alpha": "CA", "species": "HomoSapiens", "mhc_a": "HLA-A*02:01", "mhc_b": "B2M", "vdjdb_score": "1"}
    path = tsv(tmp_path / "v.tsv", tuple(names), row(**base), row(**base), row(**{**base, "vdjdb_score": "0"}), row(**{**base, "species": "MusMusculus"}))
    mri, seq = db.read_vdjdb(spark, path, alleles)
    assert (mri.count(), "vdjdb_score" in mri.columns) == (2, False)
    assert rows(seq, "tra", "mhc_one_id", "mhc_one", "mhc_two_id", "mhc_two", "source") == [("CA", "A*02:01", "MA", None, None, "vdjdb")]


def test_mcpas(spark, tmp_path, alleles):
    (tmp_path / "m.csv").write_text("PubMed.ID,Species,CDR3.beta.aa,Epitope.peptide,MHC\n1,Human,CB,P1/P2,HLA-A2\n2,Mouse,CC,,x\n")
    mri, seq = db.read_mcpas(spark, str(tmp_path / "m.csv"), alleles)
    assert rows(mri, "study_id", "trav_gene", "data_source", "study_id_type") == [("1", "", "McPAS-TCR", "PMID"), ("2", "", "McPAS-TCR", "PMID")]
    assert sorted((r.trb, r.peptide or "-", r.mhc_restriction or "-", r.mhc_one or "-") for r in seq.collect()) == [("CB", "P1", "A*02:01", "MA"), ("CB", "P2", "A*02:01", "MA"), ("CC", "-", "-", "-")]
    assert db.mcpas_tables(s.read_delimited(spark, str(tmp_path / "m.csv")), alleles, human_only=True)[0].count() == 1


def write_assays(tmp_path):
    line = lambda names, **v: tuple(v.get(n, "") for n in names)
    t = tsv(tmp_path / "t.tsv", tuple(f"h{i}" for i in range(19)), line(db.ASSAY, study_id="1", peptide="GIL + OX", assay_outcome="Positive", mhc_restriction="HLA-DRB1*04/B*07:02"), line(db.ASSAY, assay_outcome="Negative"))
    li = tsv(tmp_path / "l.tsv", tuple(f"h{i}" for i in range(19)), line(db.ASSAY, study_id="2", peptide="AAA + X", assay_outcome="Positive", mhc_restriction="HLA-A2"))
    lc = tsv(tmp_path / "c.tsv", tuple(f"h{i}" for i in range(17)), line(db.ASSAY_SHORT, study_id="3", peptide="CCC"))
    ri = tsv(tmp_path / "r.tsv", tuple(f"h{i}" for i in range(24)), line(db.RECEPTOR["iedb"], study_id="55", peptide="P + q", tra_junction_aa="CA"))
    rc = tsv(tmp_path / "rc.tsv", tuple(f"h{i}" for i in range(22)), line(db.RECEPTOR["cedar"], study_id="http://x/1234567", peptide="Q", trb_junction_aa="CB"), line(db.RECEPTOR["cedar"], study_id="12", peptide="Q2"))
    return {"iedb": {"tcell_assay": t, "mhc_ligand": li, "receptor": ri}, "cedar": {"mhc_ligand": lc, "receptor": rc}}


def test_assay_sources(spark, tmp_path, alleles):
    mri, seq = db.assay_sources(spark, write_assays(tmp_path), alleles)
    got = sorted((r.source, r.peptide, r.mhc_one_id or "-", r.mhc_two_id or "-", r.tra or "-", r.trb or "-") for r in seq.collect())
    assert got == [
        ("cedar", "CCC", "-", "-", "-", "-"), ("cedar", "Q", "-", "-", "-", "CB"), ("cedar", "Q2", "-", "-", "-", "-"),
        ("iedb", "AAA + X", "A*02:01", "-", "-", "-"), ("iedb", "GIL ", "DRB1*04:01", "B*07:02", "-", "-"), ("iedb", "P ", "-", "-", "CA", "-"),
    ]
    assert sorted((r.data_source, r.study_id or "-", r.study_id_type) for r in mri.collect()) == [
        ("cedar_mhc_ligand_assay", "3", "PMID"), ("cedar_receptor_table", "-", "CEDAR"), ("cedar_receptor_table", "CEDAR1234567", "CEDAR"),
        ("iedb_mhc_ligand_assay", "2", "PMID"), ("iedb_receptor_table", "IEDB55", "IEDB"), ("iedb_tcell_assay", "1", "PMID"),
    ]


CELLS = ["data_processing_id", "repertoire_id", "cell_id", "clone_id", "productive", "locus", "v_call", "d_call", "j_call", "junction_aa"]


def test_paired_repository(spark, tmp_path):
    data = [("dp", "r", c, "k", p, lo, "v", "", "j", x) for c, p, lo, x in (("c1", "T", "TRA", "A1"), ("c1", "T", "TRB", "B1"), ("c2", "T", "TRA", "A2"), ("", "T", "TRA", "A3"), ("", "T", "TRB", "B3"), ("", "T", "TRB", "B4"), ("c4", "F", "TRA", "AX"))]
    path = tsv(tmp_path / "d.tsv", tuple(CELLS), *data, ("other", "r", "c9", "k", "T", "TRB", "", "", "", "B9"))
    (tmp_path / "m.json").write_text(json.dumps({"Repertoire": [repertoire()]}))
    mri, seq = db.repository(spark, "airr_covid", path, str(tmp_path / "m.json"))
    assert sorted((r.tra or "-", r.trb or "-") for r in mri.collect()) == [("A1", "B1"), ("A2", "-"), ("A3", "B3"), ("A3", "B4")]
    assert sorted((r.tra or "-", r.trb or "-") for r in seq.collect()) == [("-", "B9"), ("A1", "B1"), ("A2", "-"), ("A3", "B3"), ("A3", "B4")]
    inner, _ = db.paired_observations(s.read_delimited(spark, path, "\t"), "x", "inner")
    assert inner.count() == 3


def test_bulk_repository(spark, tmp_path):
    names = [c for c in CELLS if c != "data_processing_id"]
    path = tsv(tmp_path / "d.tsv", tuple(names), ("7", "c", "k", "T", "TRA", "v", "d1", "j", "CA"), ("7", "c", "k", "T", "TRA", "v", "d2", "j", "CA"), ("7", "c", "k", "T", "TRB", "v", "d", "j", "C_B"), ("7", "c", "k", "F", "TRB", "v", "d", "j", "CX"), ("8", "c", "k", "T", "TRB", "v", "d", "j", "CY"))
    (tmp_path / "m.json").write_text(json.dumps({"Repertoire": [repertoire()]}))
    mri, seq = db.repository(spark, "paone", path, str(tmp_path / "m.json"))
    assert mri.count() == 3
    assert seq.count() == 4  # the alpha D genes differ before they are left out
    df = s.read_delimited(spark, path, "\t")
    assert db.bulk_observations(df, "x", dedupe=True)[1].count() == 3
    assert db.bulk_observations(df, "x", drop_stops=True)[0].count() == 3
    assert db.repository(spark, "paone", path, str(tmp_path / "m.json"), compat=True)[0].count() == 0


def test_ingest_skips_what_is_finished(spark, tmp_path):
    (tmp_path / "hla").mkdir()
    (tmp_path / "hla" / "A_prot.fasta").write_text(">HLA:1 A*02:01:01 365 bp\nMA\n")
    (tmp_path / "m.csv").write_text("PubMed.ID,Species,CDR3.beta.aa,Epitope.peptide,MHC\n1,Human,CB,P1,HLA-A2\n")
    tree = {"databases": {"imgt": {"hla_fasta": str(tmp_path / "hla")}, "mcpas_tcr": str(tmp_path / "m.csv"), **write_assays(tmp_path)}, "outputs": {"output_path": str(tmp_path / "out")}}
    config = pipeline.Config.of(tree)
    assert pipeline.ingest(spark, config) == {"mcpas": True, "iedb": True}
    assert spark.read.parquet(f"{tmp_path}/out/seq/mcpas_seq.parquet").first().mhc_one == "MA"
    assert pipeline.ingest(spark, config) == {"mcpas": False, "iedb": False}


def test_clean_peptides(spark):
    df = spark.createDataFrame([("G IL",), ("GILx",), ("GIL2",)], "peptide string")
    assert rows(db.clean_peptides(df)) == [("GIL",)]


def test_split_sink(spark, tmp_path):
    df = spark.createDataFrame([("a", "train"), ("b", "val")], "x string, split string")
    sinks.write_splits(df, str(tmp_path / "c"))
    assert rows(s.read_splits(spark, str(tmp_path / "c"), "val"), "x") == [("b",)]
    assert s.read_parquet(spark, [str(tmp_path / "c")]).count() == 2


def test_landing_files_once(spark, tmp_path):
    out, at = str(tmp_path / "out"), str(tmp_path / "check")
    run = lambda: follow(spark, str(tmp_path / "in"), ["RunId", "AASeq"], lambda d: d.filter("AASeq <> ''"), out, at).awaitTermination()
    tsv(tmp_path / "in" / "a.tsv", ("RunId", "AASeq"), ("r1", "CA"), ("r2", ""))
    run()
    tsv(tmp_path / "in" / "b.tsv", ("RunId", "AASeq"), ("r3", "CB"))
    run()
    run()
    assert rows(spark.read.parquet(out), "RunId", "AASeq") == [("r1", "CA"), ("r3", "CB")]


def test_corpus_builds(spark, tmp_path):
    df = spark.createDataFrame([(f"CASS{a}{b}", "GIL+x", "MA") for a in "ACDEFG" for b in "ACDEFG"], "tra string, peptide string, mhc_one string")
    df.write.parquet(str(tmp_path / "in"))
    out = pipeline.build_corpus(spark, [str(tmp_path / "in")], str(tmp_path / "c"))
    assert out.count() == 36 * 6  # seven subsets of three features less the lone peptide
    assert {r.split for r in out.select("split").distinct().collect()} == {"train", "val", "test"}
    vocab = pipeline.build_token_corpus(spark, [str(tmp_path / "in")], str(tmp_path / "t"), length=8)
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.filter(F.exists("input_ids", lambda w: F.size(w) != 8)).count() == 0
    assert vocab["[PAD]"] == 0
    assert spark.read.json(f"{tmp_path}/t_vocabulary").count() == len(vocab)
