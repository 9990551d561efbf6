"""Queries of file layouts, scans and sinks: the supplied tables are written as files and read back through the library.

The rows of each file come from one SQL text that Spark and DuckDB both run; the files' expected rows are SQL over it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.functions.schema import MRI, SEQUENCE
from chainloom.operators import corpus
from chainloom.plans.formats import MISC, numbered, set_aside
from chainloom.plans.pipeline import parse_file
from chainloom.plans.registry import query
from chainloom.sources import delimited, sinks
from chainloom.sources.scratch import one_file, scratch

PART = """SELECT p_partkey AS k, p_partkey % 4 AS kind, CASE p_size % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'x' END AS side, CAST(p_size AS STRING) AS g,
CASE WHEN p_size % 5 = 0 THEN '' ELSE 'D' || CAST(p_partkey % 3 AS STRING) END AS d, 'J' || CAST(p_size % 7 AS STRING) AS j,
'CAS' || substr(upper(p_type), 1, 2) || CAST(p_size % 6 AS STRING) AS aa, p_size % 2 = 0 AS even, CASE WHEN p_size % 4 = 0 THEN 'no' ELSE 'yes' END AS kept FROM part"""

ORDERS = """SELECT o_orderkey AS k, 'c' || CAST(o_custkey AS STRING) AS cell, o_orderkey % 3 AS m, 'C' || CAST(o_orderkey % 11 AS STRING) AS aa,
CAST(o_orderkey % 5 AS STRING) AS g, o_orderstatus AS status, o_orderkey % 7 AS s FROM orders"""

ORIGIN = {"repertoire_id": "'rep1'", "study_id": "'study'", "category": "'cat'", "molecule_type": "'rna'", "host_organism": "'human'"}


def rows_sql(names: list[str], values: dict[str, str], given: str) -> str:
    """Rows of a canonical table from given ones; columns without a value are blank."""
    return f"SELECT {', '.join(f"{values.get(n, "''")} AS {n}" for n in names)} FROM ({given}) g"


def both_sql(cells: str, mri: dict[str, str], seq: dict[str, str], compared: str, label: str, mri_label: str = "") -> str:
    """MRI and sequence rows, told apart by kind. cells: the CTEs; compared: the columns that sequences are distinct over."""
    values = {**ORIGIN, **mri, "source": f"'{mri_label or label}'"}
    one = rows_sql(MRI, values, "SELECT * FROM f")
    two = rows_sql(SEQUENCE, {**seq, "source": f"'{label}'"}, f"SELECT DISTINCT {compared} FROM f")
    both = sorted({*MRI, *SEQUENCE})
    shape = lambda names, kind: ", ".join([f"'{kind}' AS kind", *(c if c in names else f"NULL AS {c}" for c in both)])
    return f"WITH {cells} SELECT {shape(MRI, 'mri')} FROM ({one}) x UNION ALL SELECT {shape(SEQUENCE, 'seq')} FROM ({two}) y"


def both_rows(tables: tuple[DataFrame, DataFrame]) -> DataFrame:
    mri, seq = tables
    return mri.withColumn("kind", F.lit("mri")).unionByName(seq.withColumn("kind", F.lit("seq")), allowMissingColumns=True)


@dataclass(frozen=True)
class File:
    """A file to write: its kind and type, and its columns as header and SQL over the source's rows, in the source's order."""

    kind: str
    folder: str
    columns: dict[str, str]
    source: str = PART
    where: str = "true"
    extension: str = "tsv"
    first_line: str = ""


def written(spark: SparkSession, d: str, file: File, root: str, name: str = "rep1") -> str:
    for t in ("part", "orders"):
        spark.read.parquet(f"{d}/{t}.parquet").createOrReplaceTempView(t)
    said = ", ".join(f"{e} AS c{i}" for i, e in enumerate(file.columns.values()))
    rows = spark.sql(f"SELECT {said} FROM ({file.source}) s WHERE {file.where} ORDER BY k").toDF(*file.columns)
    return one_file(rows, f"{root}/cat/study/rna/{file.folder}/{name}.{file.extension}", "," if file.extension == "csv" else "\t", file.first_line)


def layout(key: str, file: File, sql: str) -> None:
    """Register the query of one layout: its file is written, recognised and parsed."""

    @query(f"layout_{key}", sql)
    def run(spark: SparkSession, d: str) -> DataFrame:
        return both_rows(parse_file(spark, written(spark, d, file, scratch(spark, key)), file.kind))


CHAIN_COLUMNS = ("v", "d", "j", "aa")
ALPHA, BETA = ("trav_gene", "trad_gene", "traj_gene", "tra"), ("trbv_gene", "trbd_gene", "trbj_gene", "trb")
SIDES = {n: f"CASE WHEN {side} THEN {c} ELSE '' END" for names, side in ((ALPHA, "al"), (BETA, "be")) for n, c in zip(names, CHAIN_COLUMNS, strict=True)}


def chained(values: dict[str, str], alpha: str, beta: str, where: str = "true", more: str = "") -> str:
    """CTEs of a single-chain layout: f has v, d, j, aa and whether the row is alpha or beta."""
    said = ", ".join(f"{values.get(c, "''")} AS {c}" for c in CHAIN_COLUMNS)
    return f"s AS ({PART}), r AS (SELECT {said}{more} FROM s WHERE {where}), t AS (SELECT *, {alpha} AS al, NOT ({alpha}) AND ({beta}) AS be FROM r), f AS (SELECT * FROM t WHERE al OR be)"


def named(alpha: str, beta: str) -> str:
    return f"CASE side WHEN 'a' THEN '{alpha}' WHEN 'b' THEN '{beta}' ELSE 'IGHV' END || g"


def by_row(key: str, columns: tuple[str, str, str, str], alpha: str, beta: str, keep: tuple[str, str, str] | None = None, kind: str = "bulk", more: dict[str, str] | None = None, label: str = "", aa: str = "aa", found: str = "aa") -> None:
    """A layout whose V column tells the chain of each row."""
    v, d, j, cdr = columns
    values = {"v": named(alpha, beta), "d": "d", "j": "j", "aa": aa}
    file = {v: values["v"], d: "d", j: "j", cdr: aa, **(more or {})}
    file.pop("", None)
    if keep:
        file[keep[0]] = f"CASE kept WHEN 'yes' THEN '{keep[1]}' ELSE '{keep[2]}' END"
    shown = {"v": values["v"], "d": "d" if d else "''", "j": "j", "aa": found}
    cells = chained(shown, f"v LIKE '%{alpha}%'", f"v LIKE '%{beta}%'", "kept = 'yes'" if keep else "true")
    label = label or f"bulk_survey_format_{key.removeprefix('bulk_')}"
    layout(key, File(kind, kind, file), both_sql(cells, SIDES, SIDES, "v, d, j, aa, al, be", label))


by_row("bulk_four", ("v_resolved", "d_resolved", "j_resolved", "amino_acid"), "TCRA", "TCRB", ("frame_type", "In", "Out"))
by_row("bulk_five", ("V_ref", "D_ref", "J_ref", "CDR3(aa)"), "TRAV", "TRBV", ("fuction", "in-frame", "out-of-frame"), more={"#ID": "k", "amino_acid": "'x'"})
by_row("bulk_six", ("vGene", "dGene", "jGene", "aminoAcid(CDR3 in lowercase)"), "TRAV", "TRBV", ("fuction", "in-frame", ""), aa="'A' || lower(substr(aa, 1, 2)) || 'BB' || lower(aa) || 'QQ' || lower(aa)", found="regexp_extract(lower(aa), '^([a-z]+)', 1)")
by_row("bulk_nine", ("v_gene", "d_gene", "j_gene", "amino_acid"), "TCRAV", "TCRBV", ("frame_type", "In", "Stop"))
by_row("bulk_eleven", ("v_b_gene", "", "j_b_gene", "cdr3_b_aa"), "TRAV", "TRBV")
by_row("misc_six", ("v", "d", "j", "cdr3aa"), "TRAV", "TRBV", kind="misc", label="misc_format", aa="CASE WHEN kept = 'no' THEN 'NA' ELSE aa END", found="CASE WHEN kept = 'no' THEN '' ELSE aa END")

_seven = {"v": f"CASE WHEN even THEN {named('TCRAV', 'TCRBV')} ELSE 'unresolved' END", "d": "CASE WHEN side = 'b' AND kind = 0 THEN 'TCRBD1' ELSE d END", "j": "CASE WHEN kind = 1 THEN CASE side WHEN 'a' THEN 'TCRAJ' WHEN 'b' THEN 'TCRBJ' ELSE 'IGHJ' END || g ELSE j END", "aa": "aa"}
_tells = lambda v, j: f"v LIKE '%{v}%' OR j LIKE '%{j}%'"
layout(
    "bulk_seven",
    File("bulk", "bulk", {"sequenceStatus": "CASE kept WHEN 'yes' THEN 'In' ELSE 'Out' END", "aminoAcid": "aa", "vMaxResolved": _seven["v"], "dMaxResolved": _seven["d"], "jMaxResolved": _seven["j"]}),
    both_sql(chained(_seven, _tells("TCRAV", "TCRAJ"), _tells("TCRBV", "TCRBJ") + " OR d LIKE '%TCRBD%'", "kept = 'yes'"), SIDES, SIDES, "v, d, j, aa, al, be", "bulk_survey_format_seven"),
)


def by_file(key: str, columns: tuple[str, str, str, str], dropped: str, first_line: str = "", mri_label: str = "") -> None:
    """A layout whose first row tells the chain of the whole file: one file of each chain."""
    v, d, j, cdr = columns
    files = {}
    for side, prefix in (("a", "TRAV"), ("b", "TRBV")):
        said = {v: f"'{prefix}' || g", d: "d", j: "j", cdr: "aa", dropped: "k", "batch": "kind"}
        said.pop("", None)
        files[side] = File("bulk", "bulk", said, where=f"side = '{side}'", extension="txt" if first_line else "tsv", first_line=first_line)
    more = ", side = 'a' AS al, side = 'b' AS be, kind"
    cells = f"s AS ({PART}), f AS (SELECT CASE side WHEN 'a' THEN 'TRAV' ELSE 'TRBV' END || g AS v, {'d' if d else "''"} AS d, j, aa{more} FROM s WHERE side <> 'x')"

    @query(f"layout_{key}", both_sql(cells, SIDES, SIDES, "v, d, j, aa, al, be, kind", f"bulk_survey_format_{key.removeprefix('bulk_')}", mri_label))
    def run(spark: SparkSession, d: str) -> DataFrame:
        root = scratch(spark, key)
        one, two = (both_rows(parse_file(spark, written(spark, d, f, f"{root}/{side}"), "bulk")) for side, f in files.items())
        return one.unionByName(two)


by_file("bulk_one", ("VGene", "", "JGene", "aaCDR3"), "VJCombo", mri_label="bulk_survey")
by_file("bulk_two", ("V alleles", "D alleles", "J alleles", "CDR3 amino acid sequence"), "Read count", first_line=f"{delimited.MITCR}\tx")
by_file("bulk_three", ("V segments", "D segments", "J segments", "CDR3 amino acid sequence"), "Count")

# Layouts with lists of chains.
_pairs = {"tra": "tra", "trb": "trb"}
_zip = "s AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS n FROM (" + PART + ") p), f AS (" + " UNION ALL ".join(
    f"SELECT CAST(n AS STRING) AS tid, {a} AS tra, {b} AS trb FROM s WHERE kind = {kind}" for kind, a, b in ((0, "aa", "g"), (0, "aa", "j"), (1, "aa", "''"), (2, "''", "j"), (3, "aa", "''"))
) + ")"
layout(
    "misc_one",
    File("misc", "misc", {"cdr3s_nt": "CASE kind WHEN 0 THEN 'TRA:n;TRB:n;TRB:n' WHEN 1 THEN 'TRA:n' WHEN 2 THEN 'TRB:n' ELSE 'TRA:n' END", "cdr3s_aa": "CASE kind WHEN 0 THEN 'TRA:' || aa || ';TRB:' || g || ';TRB:' || j WHEN 1 THEN 'TRA:' || aa WHEN 2 THEN 'TRB:' || j ELSE 'TRA:' || aa || ';TRB:' || j END"}),
    both_sql(_zip, {"tid": "tid", **_pairs}, _pairs, "tra, trb", "misc_format"),
)
_lists = "CASE kind WHEN 0 THEN 'TRA:' || aa || ';TRB:' || g || ';TRA:' || j WHEN 1 THEN 'TRB:' || j WHEN 2 THEN CASE WHEN even THEN 'broken' ELSE '' END ELSE 'tra:x;TRA:' || aa END"
_listed = "s AS (" + PART + "), f AS (" + " UNION ALL ".join(
    f"SELECT 'b' || CAST(k AS STRING) AS tid, {i} AS i, {a} AS tra, {b} AS trb FROM s WHERE kind = {kind}" for kind, i, a, b in ((0, 1, "aa", "g"), (0, 2, "j", "g"), (1, 1, "''", "j"), (3, 1, "aa", "''"))
) + ")"
_two = File("misc", "misc", {"barcode": "'b' || CAST(k AS STRING)", "cdr3s_aa": _lists})
layout("misc_two", _two, both_sql(_listed, {"tid": "tid", **_pairs}, _pairs, "tra, trb", "misc_format"))
layout(
    "misc_four",
    File("misc", "misc", {"orig.ident": "'s'", "t_cdr3s_aa": _lists, "Unnamed: 0": "'b' || CAST(k AS STRING)", "Group": "CASE WHEN even THEN 'NA' ELSE 'g' END"}),
    both_sql(_listed, {"tid": "'tcr_' || tid || '_' || CAST(i AS STRING)", **_pairs}, _pairs, "tra, trb", "single_cell"),
)


@query("malformed_chains", f"WITH s AS ({PART}) SELECT 'b' || CAST(k AS STRING) AS barcode, 'broken' AS cdr3s_aa FROM s WHERE kind = 2 AND even")
def malformed_chains(spark: SparkSession, d: str) -> DataFrame:
    path = written(spark, d, _two, scratch(spark, "malformed"))
    return set_aside(delimited.read_detected(spark, path), next(x for x in MISC if x.name == "misc_two"))


_column = f"s AS ({PART}), f AS (SELECT 'V' || g AS v, d, j, aa, side = 'a' AS al, side = 'b' AS be, 's' || CAST(kind AS STRING) AS sample_id FROM s WHERE side <> 'x')"
layout(
    "misc_three",
    File("misc", "misc", {"sample_id": "'s' || CAST(kind AS STRING)", "TR_chain": "CASE side WHEN 'a' THEN 'TRA' WHEN 'b' THEN 'TRB' ELSE 'IGH' END", "subject_id": "'p'", "CDR3.aa": "aa", "V.name": "'V' || g", "D.name": "d", "J.name": "j"}),
    both_sql(_column, SIDES, SIDES, "v, d, j, aa, al, be, sample_id", "misc_format"),
)
_wide = {"tra": "aa", "trav_gene": "'AV' || g", "trad_gene": "d", "traj_gene": "j", "trb": "CASE WHEN kind = 0 THEN '' ELSE 'B' || aa END", "trbv_gene": "'BV' || g", "trbd_gene": "d", "trbj_gene": "j"}
layout(
    "misc_five",
    File("misc", "misc", {"orig.ident": "'o'", "barcode": "'b' || CAST(k AS STRING)", "Tissue": "'t'", "PatientID": "'p'", "CDR3A": "aa", "TRAV": "'AV' || g", "TRAD": "d", "TRAJ": "j", "CDR3B": "CASE WHEN kind = 0 THEN 'nan' ELSE 'B' || aa END", "TRBV": "'BV' || g", "TRBD": "d", "TRBJ": "j"}),
    both_sql(f"s AS ({PART}), f AS (SELECT 'b' || CAST(k AS STRING) AS tid, {', '.join(f'{e} AS {c}' for c, e in _wide.items())} FROM s)", {"tid": "tid", **{c: c for c in _wide}}, {c: c for c in _wide}, ", ".join(_wide), "misc_format"),
)


# Paired layouts: all pairs of a cell's chains, numbered alpha by alpha.
def cell_pairs(alpha: str, beta: str, where: str, parts: tuple[str, str, str, str]) -> str:
    aa, v, d, j = parts
    return f"""o AS ({ORDERS}), q AS (SELECT cell, k, {aa} AS c, {v} AS v, {d} AS d, {j} AS j, {alpha} AS al, {beta} AS be FROM o WHERE {where}),
a AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY k) AS n FROM q WHERE al), b AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY k) AS n FROM q WHERE be),
nb AS (SELECT cell, count(*) AS size FROM b GROUP BY cell),
p AS (SELECT coalesce(a.cell, b.cell) AS cell, coalesce(a.n - 1, 0) * coalesce(nb.size, 1) + coalesce(b.n - 1, 0) + 1 AS i, a.c AS ac, a.v AS av, a.d AS ad, a.j AS aj, b.c AS bc, b.v AS bv, b.d AS bd, b.j AS bj
FROM a FULL JOIN b ON a.cell = b.cell LEFT JOIN nb ON nb.cell = a.cell),
f AS (SELECT cell || '_' || CAST(i AS STRING) AS tid, {', '.join(f"coalesce({x}{y}, '') AS {n}" for x, names in (('a', ('tra', 'trav_gene', 'trad_gene', 'traj_gene')), ('b', ('trb', 'trbv_gene', 'trbd_gene', 'trbj_gene'))) for y, n in zip('cvdj', names, strict=True))},
CASE WHEN ac IS NULL THEN bc WHEN bc IS NULL THEN ac ELSE ac || ' ' || bc END || ';' AS sequence FROM p)"""


_of_pairs = {c: c for c in ("tid", *ALPHA, *BETA)}
layout(
    "contigs",
    File("paired", "contigs", {"barcode": "cell", "chain": "CASE m WHEN 0 THEN 'TRA' WHEN 1 THEN 'TRB' ELSE 'IGH' END", "cdr3": "aa", "v_gene": "'V' || g", "d_gene": "''", "j_gene": "'J' || g", "productive": "CASE status WHEN 'P' THEN 'False' WHEN 'F' THEN 'True' ELSE 'TRUE' END", "high_confidence": "CASE WHEN s = 0 THEN 'false' ELSE 'true' END"}, ORDERS, extension="csv"),
    both_sql(cell_pairs("m = 0", "m = 1", "m < 2 AND status <> 'P' AND s <> 0", ("aa", "'V' || g", "''", "'J' || g")), {**_of_pairs, "sequence": "sequence"}, _of_pairs, ", ".join(_of_pairs), "single_cell"),
)
_airr_v, _airr_j = "CASE m WHEN 0 THEN 'TRAV' WHEN 1 THEN 'TRBV' ELSE 'IGHV' END || g", "CASE WHEN s = 1 THEN 'TRBJ' ELSE 'J' END || g"
layout(
    "airr",
    File("paired", "airr", {"cell_id": "cell", "is_cell": "CASE WHEN s = 0 THEN 'F' ELSE 'T' END", "productive": "CASE status WHEN 'P' THEN 'F' ELSE 'T' END", "v_call": _airr_v, "d_call": "''", "j_call": _airr_j, "junction_aa": "aa"}, ORDERS),
    both_sql(cell_pairs("m = 0", "m = 1 OR s = 1", "(m < 2 OR s = 1) AND status <> 'P' AND s <> 0", ("aa", _airr_v, "''", _airr_j)), {**_of_pairs, "sequence": "sequence"}, _of_pairs, ", ".join(_of_pairs), "single_cell"),
)
_last = {"tid": "'q' || CAST(k AS STRING)", "tra": "CASE kind WHEN 0 THEN j WHEN 3 THEN aa ELSE '' END", "trb": "CASE kind WHEN 0 THEN g WHEN 1 THEN j ELSE '' END"}
layout(
    "clonotypes",
    File("paired", "clonotypes", {"clonotype_id": "'q' || CAST(k AS STRING)", "cdr3s_aa": "CASE kind WHEN 0 THEN 'TRA:' || aa || ';TRB:' || g || ';tra: ' || j WHEN 1 THEN 'TRB:' || j WHEN 2 THEN 'none' ELSE 'TRA:' || aa END"}, extension="csv"),
    both_sql(f"s AS ({PART}), f AS (SELECT {', '.join(f'{e} AS {c}' for c, e in _last.items())} FROM s)", {c: c for c in _last}, {c: c for c in _last}, ", ".join(_last), "single_cell"),
)


# Scans and sinks.
def customers(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("string").alias("id"), "c_name", F.when(F.col("c_nationkey") % 4 == 0, "").otherwise(F.concat(F.lit('say "'), "c_mktsegment", F.lit('", then'))).alias("note"), F.col("c_nationkey").cast("string").alias("nation"))


CUSTOMERS = """SELECT CAST(c_custkey AS STRING) AS id, c_name, CASE WHEN c_nationkey % 4 = 0 THEN '' ELSE 'say "' || c_mktsegment || '", then' END AS note, CAST(c_nationkey AS STRING) AS nation FROM customer"""


def scan(key: str, sep: str, sql: str = CUSTOMERS, **options: object) -> None:
    """Register a scan of delimited files with quotes, separators inside of them and empty fields."""

    @query(key, sql)
    def run(spark: SparkSession, d: str) -> DataFrame:
        root = f"{scratch(spark, key)}/rows"
        customers(spark, d).write.options(sep=sep, header=True, quote='"', escape='"', emptyValue="").csv(root)
        return delimited.read_delimited(spark, root, sep, **options)


scan("scan_tsv", "\t")
scan("scan_csv", ",")
scan("scan_positional", "\t", f"SELECT id AS a, c_name AS b, note AS c, nation AS d FROM ({CUSTOMERS}) c", names=["a", "b", "c", "d"])


@query("scan_lazy_blocks", f"SELECT nation, count(*) AS n FROM ({CUSTOMERS}) c GROUP BY nation")
def scan_lazy_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Files that split: the scan is lazy, and only the counted column is parsed."""
    root = f"{scratch(spark, 'lazy')}/rows"
    customers(spark, d).repartition(4).write.options(sep="\t", header=True, quote='"', escape='"', emptyValue="").csv(root)
    return delimited.read_delimited(spark, root, "\t").groupBy("nation").agg(F.count(F.lit(1)).alias("n"))


@query("scan_missing", "SELECT '' AS a, '' AS b WHERE false")
def scan_missing(spark: SparkSession, d: str) -> DataFrame:
    return delimited.read_delimited(spark, f"{scratch(spark, 'missing')}/none", names=["a", "b"])


@query("scan_sniffed", f"SELECT 'tsv' AS kind, * FROM ({CUSTOMERS}) c UNION ALL SELECT 'csv', * FROM ({CUSTOMERS}) c UNION ALL SELECT 'mitcr', * FROM ({CUSTOMERS}) c")
def scan_sniffed(spark: SparkSession, d: str) -> DataFrame:
    """Delimiters guessed from the files' heads, one of which has a line before its header."""
    root, rows = scratch(spark, "sniffed"), customers(spark, d)
    paths = {"tsv": one_file(rows, f"{root}/one.tsv"), "csv": one_file(rows, f"{root}/two.csv", ","), "mitcr": one_file(rows, f"{root}/three.txt", first_line=f"{delimited.MITCR}\tx")}
    read = [delimited.read_detected(spark, p).withColumn("kind", F.lit(k)) for k, p in paths.items()]
    return read[0].unionByName(read[1]).unionByName(read[2])


@query("scan_tree", "SELECT CAST(c_custkey AS STRING) AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS c_name, c_mktsegment AS seg, CASE WHEN c_custkey % 2 = 0 THEN 'even 1' ELSE 'odd+2' END AS study_id FROM customer")
def scan_tree(spark: SparkSession, d: str) -> DataFrame:
    """Files in folders of a tree whose columns differ in number and order."""
    root, c = scratch(spark, "tree"), spark.read.parquet(f"{d}/customer.parquet")
    one_file(c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), "c_name", F.col("c_mktsegment").alias("seg")), f"{root}/a/even 1.tsv")
    one_file(c.filter("c_custkey % 2 = 1").select(F.col("c_mktsegment").alias("seg"), F.col("c_custkey").alias("id")), f"{root}/b/c/odd+2.tsv")
    return delimited.read_tree(spark, root)


@query(
    "scan_fasta",
    """WITH r AS (SELECT p_partkey AS k, chr(CAST(65 + p_partkey % 3 AS INTEGER)) || '*' || lpad(CAST(p_size AS VARCHAR), 2, '0') || ':' || lpad(CAST(p_partkey % 5 AS VARCHAR), 2, '0') AS allele,
upper(replace(p_name, ' ', '')) || 'MK' || CAST(p_partkey AS VARCHAR) AS protein FROM part) SELECT allele, arg_min(protein, k) AS protein FROM r GROUP BY allele""",
)
def scan_fasta(spark: SparkSession, d: str) -> DataFrame:
    """Records of three header fields and two lines; the first one of each allele counts."""
    p = spark.read.parquet(f"{d}/part.parquet")
    two = F.lpad((F.col("p_partkey") % 5).cast("string"), 2, "0")
    allele = F.concat(F.char(65 + F.col("p_partkey") % 3), F.lit("*"), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit(":"), two, F.lit(":01"))
    record = F.concat(F.lit(">HLA:"), F.col("p_partkey").cast("string"), F.lit(" "), allele, F.lit(" 9 bp\n"), F.upper(F.replace("p_name", F.lit(" "), F.lit(""))), F.lit("\nMK"), F.col("p_partkey").cast("string"))
    root = f"{scratch(spark, 'fasta')}/x_prot.fasta"
    p.orderBy("p_partkey").select(record.alias("value")).coalesce(1).write.text(root)
    return delimited.read_fasta(spark, root, "part-*")


@query(
    "scan_repertoires",
    """SELECT DISTINCT 'S' || CAST(c_nationkey AS VARCHAR) AS study_id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'dp' || CAST(c_custkey % 50 AS VARCHAR) END AS repertoire_id, 'human' AS host_organism,
CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 4 = 1 THEN 'Case flu' ELSE 'Control' END AS condition_studies, '' AS age, 'F' AS sex, '' AS population_surveyed, 'blood' AS source_tissue,
CASE WHEN c_custkey % 2 = 0 THEN 'A*01:01,B*07:02' ELSE '' END AS mhc_profile FROM customer WHERE c_custkey % 11 <> 0""",
)
def scan_repertoires(spark: SparkSession, d: str) -> DataFrame:
    """JSON of repertoires; records without a study are left out."""
    c, none = spark.read.parquet(f"{d}/customer.parquet"), F.lit(None).cast("string")
    k = F.col("c_custkey")
    diagnosis = F.when(k % 4 != 0, F.array(F.struct(F.when(k % 4 == 1, "Case").otherwise("Control").alias("study_group_description"), F.struct(F.when(k % 4 == 1, "flu").alias("label")).alias("disease_diagnosis"))))
    alleles = F.when(k % 2 == 0, F.array(*(F.struct(F.lit(a).alias("allele_designation")) for a in ("B*07:02", "A*01:01", "B*07:02"))))
    one = F.struct(
        F.concat(F.lit("r"), k).alias("repertoire_id"),
        F.struct(F.when(k % 11 != 0, F.concat(F.lit("S"), F.col("c_nationkey"))).alias("study_id")).alias("study"),
        F.when(k % 3 != 0, F.array(F.struct(F.concat(F.lit("dp"), k % 50).alias("data_processing_id")))).alias("data_processing"),
        F.struct(none.alias("age"), F.lit("F").alias("sex"), F.struct(F.lit("human").alias("label")).alias("species"), diagnosis.alias("diagnosis"), F.struct(F.struct(F.array(F.struct(alleles.alias("mhc_alleles"))).alias("mhc_genotype_list")).alias("mhc_genotype_set")).alias("genotype")).alias("subject"),
        F.array(F.struct(F.struct(F.lit("blood").alias("label")).alias("tissue"))).alias("sample"),
    )
    root = f"{scratch(spark, 'repertoires')}/rows"
    c.groupBy("c_nationkey").agg(F.collect_list(one).alias("Repertoire")).write.partitionBy("c_nationkey").json(root)  # a document a file
    return delimited.read_repertoires(spark, root)


@query("scan_parquet_globs", "SELECT c_custkey, c_name FROM customer")
def scan_parquet_globs(spark: SparkSession, d: str) -> DataFrame:
    root, c = scratch(spark, "globs"), spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name")
    for i in range(3):
        sinks.write_table(c.filter(F.col("c_custkey") % 3 == i), f"{root}/{'x' if i < 2 else 'y'}/part{i}.parquet")
    return delimited.read_parquet(spark, [f"{root}/x/part*.parquet", f"{root}/y/*"])


@query("sink_splits", "SELECT c_custkey, c_name, 'test' AS split FROM customer WHERE c_custkey % 10 = 0")
def sink_splits(spark: SparkSession, d: str) -> DataFrame:
    """A corpus saved by split, of which one is read."""
    root, k = f"{scratch(spark, 'splits')}/corpus", F.col("c_custkey") % 10
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name", F.when(k == 0, "test").when(k == 1, "validation").otherwise("train").alias("split"))
    sinks.write_splits(c, root)
    return delimited.read_splits(spark, root, "test")


@query("sink_pair_once", "SELECT 'mri' AS kind, c_custkey AS id FROM customer UNION ALL SELECT 'seq', c_nationkey FROM customer UNION ALL SELECT 'written', 1 UNION ALL SELECT 'again', 0 UNION ALL SELECT 'empty', 0")
def sink_pair_once(spark: SparkSession, d: str) -> DataFrame:
    """Both tables of a source are written once, a second run leaves them alone, and empty tables aren't written."""
    root, c = scratch(spark, "pair"), spark.read.parquet(f"{d}/customer.parquet")
    mri, seq = c.select(F.col("c_custkey").alias("id")), c.select(F.col("c_nationkey").cast("long").alias("id"))
    done = [("written", int(sinks.write_pair(mri, seq, root, "own"))), ("again", int(sinks.write_pair(mri.limit(1), seq.limit(1), root, "own")))]
    sinks.write_pair(mri.limit(0), seq.limit(0), root, "none")
    done.append(("empty", int(sinks.exists(spark, f"{root}/seq/none_seq.parquet") or sinks.exists(spark, f"{root}/mri/none_mri.parquet"))))
    read = [spark.read.parquet(f"{root}/{k}/own_{k}.parquet").withColumn("kind", F.lit(k)) for k in ("mri", "seq")]
    return read[0].unionByName(read[1]).unionByName(spark.createDataFrame(done, "kind string, id long"))


@query("path_origin", "SELECT 'rep1' AS repertoire_id, 'bulk' AS file_type, 'rna' AS molecule_type, 'study' AS study_id, 'cat' AS category, count(*) AS n FROM part")
def path_origin(spark: SparkSession, d: str) -> DataFrame:
    path = written(spark, d, File("bulk", "bulk", {"k": "k"}), scratch(spark, "origin"))
    rows = delimited.read_delimited(spark, path, "\t", path_columns=True)
    return rows.groupBy(*delimited.PATH_PARTS).agg(F.count(F.lit(1)).alias("n"))


@query("first_rows", "SELECT c_custkey, c_name, rank - 1 AS place FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS rank FROM customer) c WHERE rank <= 50")
def first_rows(spark: SparkSession, d: str) -> DataFrame:
    """The first rows of an ordered scan, with their places."""
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name").orderBy("c_custkey")
    return numbered(delimited.read_limited(c, 50)).withColumnRenamed("_row", "place")


@query("comma_explode", "SELECT c_custkey, unnest(CASE WHEN c_nationkey % 3 = 0 THEN [NULL] ELSE string_split(c_name || ', ' || c_mktsegment, ', ') END) AS value FROM customer")
def comma_explode(spark: SparkSession, d: str) -> DataFrame:
    """Lists with a comma and a blank between; an empty string is one null row."""
    from chainloom.functions.exprs import split_or_none

    c = spark.read.parquet(f"{d}/customer.parquet")
    said = F.when(F.col("c_nationkey") % 3 == 0, "").otherwise(F.concat_ws(", ", "c_name", "c_mktsegment"))
    return c.select("c_custkey", F.explode_outer(split_or_none(said, ", ")).alias("value"))


@query("rank_batches", "SELECT rank, batch, count(*) AS n, min(k) AS first, max(k) AS last FROM (SELECT k % 3 AS rank, (k // 3) // 64 AS batch, k FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders) o WHERE k < (SELECT count(*) FROM orders) // 3 * 3) r WHERE batch < ((SELECT count(*) FROM orders) // 3) // 64 GROUP BY ALL")
def rank_batches(spark: SparkSession, d: str) -> DataFrame:
    """Rows dealt to ranks in turn, the same number for each, in full batches; the rest is dropped."""
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey")
    rows = corpus.rank_batches(o, "o_orderkey", ranks=3, batch=64)
    return rows.groupBy("rank", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"), F.max("place").alias("last"))
