import pytest
from pyspark.sql import functions as F

from chainloom.functions.schema import MRI, SEQUENCE
from chainloom.plans import formats as f
from chainloom.plans.pipeline import parse_file

LAYOUTS = {x.name: x for x in [*f.BULK, *f.MISC, *f.PAIRED.values()]}


def parse(spark, name, rows, columns=None, **options):
    layout = LAYOUTS[name]
    columns = columns or list(layout.required)
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], ", ".join(f"`{c}` string" for c in columns) + ", _row long")
    mri, seq = f.parse_layout(df, layout, {"repertoire_id": "r1", "study_id": "s1", "category": "c1", "molecule_type": "m1"}, **options)
    assert mri.columns == MRI
    assert seq.columns == SEQUENCE
    return [r.asDict() for r in mri.collect()], [r.asDict() for r in seq.collect()]


def pick(rows, *names):
    return sorted(tuple(r[n] for n in names) for r in rows)


CHAIN = ("trav_gene", "trad_gene", "traj_gene", "tra", "trbv_gene", "trbd_gene", "trbj_gene", "trb")

SINGLE = {
    "bulk_four": ([("TCRAV1", "D", "J", "CA", "In"), ("TCRBV1", "D", "J", "CB", "In"), ("TCRDV1", "D", "J", "CD", "In"), ("TCRAV1", "D", "J", "CX", "Out")], [("", "", "", "", "TCRBV1", "D", "J", "CB"), ("TCRAV1", "D", "J", "CA", "", "", "", "")]),
    "bulk_five": ([("TRAV1", "D", "J", "CA", "in-frame", "1", "z"), ("TRBV1", "D", "J", "CB", "in-frame", "2", "z"), ("TRBV1", "D", "J", "CB", "out", "3", "z")], [("", "", "", "", "TRBV1", "D", "J", "CB"), ("TRAV1", "D", "J", "CA", "", "", "", "")]),
    "bulk_six": ([("TRAV1", "D", "J", "ABcassDEcaX", "in-frame"), ("TRBV1", "D", "J", "XcaY", "in-frame")], [("", "", "", "", "TRBV1", "D", "J", "ca"), ("TRAV1", "D", "J", "cass", "", "", "", "")]),
    "bulk_seven": ([("In", "CA", "TCRAV1", "", "J"), ("In", "CB", "", "TCRBD1", "J"), ("In", "CA2", "TCRBV1", "", "TCRAJ1"), ("Out", "CX", "TCRAV1", "", "")], [("", "", "", "", "", "TCRBD1", "J", "CB"), ("TCRAV1", "", "J", "CA", "", "", "", ""), ("TCRBV1", "", "TCRAJ1", "CA2", "", "", "", "")]),
    "bulk_nine": ([("TCRAV1", "D", "J", "CA", "In"), ("TCRBV1", "D", "J", "CB", "In"), ("TCRGV1", "D", "J", "CG", "In")], [("", "", "", "", "TCRBV1", "D", "J", "CB"), ("TCRAV1", "D", "J", "CA", "", "", "", "")]),
    "bulk_eleven": ([("TRAV1", "J", "CA"), ("TRBV1", "J", "CB"), ("x", "J", "CX")], [("", "", "", "", "TRBV1", "", "J", "CB"), ("TRAV1", "", "J", "CA", "", "", "", "")]),
    "misc_six": ([("CA", "TRAV1", "D", "J"), ("CB", "TRBV1", "D", "J"), ("CX", "IGHV", "D", "J")], [("", "", "", "", "TRBV1", "D", "J", "CB"), ("TRAV1", "D", "J", "CA", "", "", "", "")]),
}


@pytest.mark.parametrize("name", list(SINGLE))
def test_chain_by_row(spark, name):
    rows, expected = SINGLE[name]
    mri, seq = parse(spark, name, rows)
    assert pick(mri, *CHAIN) == expected
    assert pick(seq, *CHAIN) == expected
    assert {r["source"] for r in mri} == {LAYOUTS[name].label}
    assert {(r["repertoire_id"], r["study_id"], r["category"], r["molecule_type"], r["host_organism"]) for r in mri} == {("r1", "s1", "c1", "m1", "human")}


@pytest.mark.parametrize(("name", "width"), [("bulk_one", 3), ("bulk_two", 4), ("bulk_three", 4)])
def test_chain_by_first_row(spark, name, width):
    layout = LAYOUTS[name]
    value = {layout.v: "TRBV2", layout.j: "J", layout.aa: "CB", layout.d: "D"}
    row = tuple(value[c] for c in layout.required)
    later = tuple({**value, layout.v: "TRAV9"}[c] for c in layout.required)
    mri, seq = parse(spark, name, [row, row, later])
    assert len(row) == width
    d = "" if width == 3 else "D"
    assert pick(mri, *CHAIN) == [("", "", "", "", "TRAV9", d, "J", "CB"), ("", "", "", "", "TRBV2", d, "J", "CB"), ("", "", "", "", "TRBV2", d, "J", "CB")]
    assert len(seq) == 2
    assert {r["source"] for r in mri} == {layout.mri_label or layout.label}
    assert {r["source"] for r in seq} == {layout.label}


def test_first_row_without_chain_is_an_error(spark):
    with pytest.raises(ValueError, match="tells no chain"):
        parse(spark, "bulk_one", [("IGHV", "J", "C")])


def test_other_columns_count_in_comparing_sequences(spark):
    columns = ["VGene", "JGene", "aaCDR3", "VJCombo", "other"]
    rows = [("TRAV1", "J", "CA", "1", "x"), ("TRAV1", "J", "CA", "2", "x"), ("TRAV1", "J", "CA", "3", "y")]
    assert len(parse(spark, "bulk_one", rows, columns)[1]) == 2
    assert len(parse(spark, "bulk_one", rows, columns, dedupe=True)[1]) == 1


def test_misc_one_pairs_by_index(spark):
    mri, seq = parse(spark, "misc_one", [("TRA:n1;TRB:n2;TRB:n3", "TRA:CA;TRB:CB1;TRB:CB2"), ("TRA:n1", "TRA:CA")])
    assert pick(mri, "tid", "tra", "trb") == [("0", "CA", "CB1"), ("0", "CA", "CB2"), ("1", "CA", "")]
    assert pick(seq, "tid", "tra", "trb") == [("", "CA", ""), ("", "CA", "CB1"), ("", "CA", "CB2")]


def test_misc_two_keeps_all_chains(spark):
    mri, _ = parse(spark, "misc_two", [("b1", "TRA:CA1;TRB:CB1;TRA:CA2"), ("b2", "TRB:CB"), ("b3", "broken")])
    assert pick(mri, "tid", "tra", "trb") == [("b1", "CA1", "CB1"), ("b1", "CA2", "CB1"), ("b2", "", "CB")]


def test_misc_two_with_one_chain_only(spark):
    assert pick(parse(spark, "misc_two", [("b2", "TRB:CB")])[1], "tra", "trb") == [("", "CB")]


def test_misc_three(spark):
    mri, seq = parse(spark, "misc_three", [("x", "TRA", "p", "CA", "V", "D", "J"), ("x", "TRB", "p", "CB", "V", "D", "J"), ("x", "IGH", "p", "CX", "V", "D", "J")])
    assert pick(mri, *CHAIN) == [("", "", "", "", "V", "D", "J", "CB"), ("V", "D", "J", "CA", "", "", "", "")]
    assert {r["repertoire_id"] for r in mri} == {"r1"}
    assert len(seq) == 2


def test_misc_four(spark):
    mri, seq = parse(spark, "misc_four", [("s", "TRA:CA1;TRA:CA2;TRB:CB", "bc", "g"), ("s", "NA", "bd", "g"), ("s", "", "be", "g")])
    assert pick(mri, "tid", "tra", "trb", "repertoire_id", "source") == [("tcr_bc_1", "CA1", "CB", "r1", "single_cell"), ("tcr_bc_2", "CA2", "CB", "r1", "single_cell")]
    assert pick(seq, "tra", "trb") == [("CA1", "CB"), ("CA2", "CB")]


def test_misc_five(spark):
    row = ("o", "bc", "t", "p", "CA", "AV", "AD", "AJ", "CB", "BV", "BD", "BJ")
    mri, seq = parse(spark, "misc_five", [row, row])
    assert pick(mri, "tid", "tra", "trb") == [("bc", "CA", "CB")] * 2
    assert pick(seq, "tid", *CHAIN) == [("", "AV", "AD", "AJ", "CA", "BV", "BD", "BJ", "CB")]


def test_misc_null_tokens(spark):
    rows = [("CNAL", "TRAV1", "NA", "J")]
    assert pick(parse(spark, "misc_six", rows)[0], "tra", "trad_gene") == [("CNAL", "")]
    assert pick(parse(spark, "misc_six", rows, compat_null_tokens=True)[0], "tra", "trad_gene") == [("CL", "")]


def test_contigs(spark):
    rows = [("c1", ch, s, "v", "d", "j", "True", "true") for ch, s in (("TRA", "A1"), ("TRB", "B1"), ("TRA", "A2"), ("TRB", "B2"))]
    rows += [("c2", "TRB", "B3", "v", "d", "j", "TRUE", "True"), ("c2", "IGH", "X", "v", "d", "j", "True", "True"), ("c3", "TRA", "A9", "v", "d", "j", "False", "True")]
    mri, _ = parse(spark, "contigs", rows)
    assert pick(mri, "tid", "tra", "trb", "sequence") == [("c1_1", "A1", "B1", "A1 B1;"), ("c1_2", "A1", "B2", "A1 B2;"), ("c1_3", "A2", "B1", "A2 B1;"), ("c1_4", "A2", "B2", "A2 B2;"), ("c2_1", "", "B3", "B3;")]


def test_clonotypes_keep_the_last_chain(spark):
    mri, _ = parse(spark, "clonotypes", [("TRA:CA1;TRB:CB1;TRA:CA2", "b1"), ("", "b2")], ["cdr3s_aa", "barcode"])
    assert pick(mri, "tid", "tra", "trb") == [("b1", "CA2", "CB1"), ("b2", "", "")]
    assert pick(parse(spark, "clonotypes", [("TRA:CA1",)])[0], "tid") == [("row_index_0",)]


def test_rearrangements_row_in_both_chains(spark):
    rows = [("c1", "T", "T", "TRAV1", "", "TRAJ1", "CA"), ("c1", "T", "T", "TRBV1", "", "", "CB"), ("c1", "T", "F", "TRBV2", "", "", "CX"), ("c2", "F", "T", "TRAV1", "", "", "CA"), ("c3", "T", "T", "TRAV1", "", "TRBJ1", "CC")]
    mri, _ = parse(spark, "airr", rows)
    assert pick(mri, "tid", "tra", "trb") == [("c1_1", "CA", "CB"), ("c3_1", "CC", "CC")]


@pytest.mark.parametrize("layout", [*f.BULK, *[m for m in f.MISC if m.name != "misc_two"]], ids=lambda x: x.name)
def test_recognition_by_required_columns(layout):
    pool = f.BULK if layout.kind == "bulk" else f.MISC
    assert f.recognise([*layout.required, "unknown"], pool) is layout


def test_recognition_errors():
    with pytest.raises(ValueError, match="no layout"):
        f.recognise(["x"], f.BULK)
    four, nine = LAYOUTS["bulk_four"], LAYOUTS["bulk_nine"]
    with pytest.raises(ValueError, match="several layouts"):
        f.recognise([*four.required, *nine.required], f.BULK)
    assert f.recognise([*four.required, *nine.required], f.BULK, {"bulk_nine": {*four.required, *nine.required}}) is nine
    with pytest.raises(ValueError, match="no paired layout"):
        f.paired_layout("other")


def test_whole_file_from_its_path(spark, tmp_path):
    folder = tmp_path / "cat" / "study" / "rna" / "bulk"
    folder.mkdir(parents=True)
    (folder / "rep1.tsv").write_text("cdr3_b_aa\tv_b_gene\tj_b_gene\nCASS\tTRBV1\t\n")
    mri, seq = parse_file(spark, str(folder / "rep1.tsv"), "bulk")
    row = mri.first()
    assert (row.trb, row.trbj_gene, row.repertoire_id, row.study_id, row.category, row.molecule_type) == ("CASS", "", "rep1", "study", "cat", "rna")
    assert seq.first().source == "bulk_survey_format_eleven"


def test_mitcr_file(spark, tmp_path):
    folder = tmp_path / "cat" / "study" / "rna" / "bulk"
    folder.mkdir(parents=True)
    (folder / "rep2.txt").write_text("MiTCRFullExportV1.1\tx\nV alleles\tD alleles\tJ alleles\tCDR3 amino acid sequence\nTRBV1\tD\tJ\tCASS\n")
    mri, _ = parse_file(spark, str(folder / "rep2.txt"), "bulk")
    assert [(r.trbv_gene, r.trb) for r in mri.collect()] == [("TRBV1", "CASS")]


def test_paired_file(spark, tmp_path):
    folder = tmp_path / "cat" / "study" / "rna" / "clonotypes"
    folder.mkdir(parents=True)
    (folder / "rep3.csv").write_text('clonotype_id,cdr3s_aa\nct1,"TRA:CA;TRB:CB"\n')
    mri, _ = parse_file(spark, str(folder / "rep3.csv"), "paired")
    assert [(r.tid, r.tra, r.trb, r.source) for r in mri.collect()] == [("ct1", "CA", "CB", "single_cell")]


def test_flattened_chain_string(spark):
    df = spark.createDataFrame([("x", "TRA:a;TRB:b")], "k string, s string")
    assert [(r.chain, r.seq) for r in f.chain_table(df, "s").collect()] == [("TRA", "a"), ("TRB", "b")]
    assert f.sequence_text(df.withColumn("tra", F.lit("CA"))).first().sequence == "CA;"
    assert [t.count() for t in f.no_rows(df)] == [0, 0]


@pytest.mark.parametrize(("kind", "file_type", "named"), [("misc", "misc", "{}"), ("paired", "clonotypes", "row_index_{}")])
def test_rows_of_a_file_read_in_pieces_are_numbered_without_gaps(spark, tmp_path, kind, file_type, named):
    folder = tmp_path / "cat" / "study" / "rna" / file_type
    folder.mkdir(parents=True)
    head, rows = "cdr3s_nt\tcdr3s_aa\tother (x)\n", [f"TRA:n\tTRA:CA{i}\t\n" for i in range(300)]
    (folder / "rep4.tsv").write_text(head + "".join(rows))
    with_small_pieces = {"spark.sql.files.maxPartitionBytes": "512", "spark.sql.files.openCostInBytes": "1"}
    for k, v in with_small_pieces.items():
        spark.conf.set(k, v)
    try:
        got = parse_file(spark, str(folder / "rep4.tsv"), kind)[0].select("tid", "tra").collect()
    finally:
        for k in with_small_pieces:
            spark.conf.unset(k)
    assert sorted((r.tid, r.tra) for r in got) == sorted((named.format(i), f"CA{i}") for i in range(300))
