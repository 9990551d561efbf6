"""File layouts as data: what a header must hold, which rows stay, how the chain is told, which column goes where.

One interpreter builds a projection from a layout; there is no code per layout. Rows carry an ordinal from the scan on,
since the first row decides some files' chain and lists keep file order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainloom.functions.exprs import chain_all, chain_entries, chain_last, chain_malformed, chain_zipped, contains_any, joined_sequence, longest_lower, null_tokens
from chainloom.functions.schema import MRI, SEQUENCE, canonical, empty, or_blank, quoted
from chainloom.operators.pairing import pair_arrays, pair_chains
from chainloom.sources.scratch import scratch

ROW = "_row"


@dataclass(frozen=True)
class Layout:
    """chain: "row" decides by each row, "file" by the first row, "none" if the layout pairs or renames itself."""

    name: str
    required: tuple[str, ...]
    label: str
    kind: str = "bulk"
    keep: tuple[tuple[str, tuple[str, ...]], ...] = ()
    chain: str = "row"
    alpha: tuple[tuple[str, str], ...] = ()
    beta: tuple[tuple[str, str], ...] = ()
    v: str = ""
    d: str = ""
    j: str = ""
    aa: str = ""
    dropped: tuple[str, ...] = ()
    exact: tuple[str, ...] = ()
    mri_label: str = ""
    extra: dict[str, str] = field(default_factory=dict, hash=False)


def bulk(n: str, v: str, d: str, j: str, aa: str, alpha: str, beta: str, keep: tuple = (), chain: str = "row", more: tuple[str, ...] = (), **rest: object) -> Layout:
    """A layout of single chains whose V column tells the chain."""
    required = tuple(x for x in (v, d, j, aa, *(k for k, _ in keep), *more) if x)
    return Layout(f"bulk_{n}", required, f"bulk_survey_format_{n}", keep=keep, chain=chain, alpha=((v, alpha),), beta=((v, beta),), v=v, d=d, j=j, aa=aa, **rest)


IN_FRAME = (("frame_type", ("In",)),)
FUNCTION = (("fuction", ("in-frame",)),)
STATUS = (("sequenceStatus", ("In",)),)
TRUE = ("True", "true", "TRUE")

# Columns that layouts one to three leave out before rows are compared.
DROPPED_ONE = ("VJCombo", "Copy", "ntCDR3", "NetInsertionLength")
DROPPED_TWO = ("Read count", "Percentage", "CDR3 nucleotide sequence", "CDR3 nucleotide quality", "Min quality", "V segments", "J segments", "D segments", "Last V nucleotide position ", "First D nucleotide position", "Last D nucleotide position", "First J nucleotide position", "VD insertions", "DJ insertions", "Total insertions")
DROPPED_THREE = ("Count", "Percentage", "CDR3 nucleotide sequence", "Last V nucleotide position", "First D nucleotide position", "Last D nucleotide position", "First J nucleotide position", "Good events", "Total events", "Good reads", "Total reads")

SEVEN = Layout(
    "bulk_seven", ("sequenceStatus", "aminoAcid", "vMaxResolved", "dMaxResolved", "jMaxResolved"), "bulk_survey_format_seven",
    keep=STATUS, alpha=(("vMaxResolved", "TCRAV"), ("jMaxResolved", "TCRAJ")), beta=(("vMaxResolved", "TCRBV"), ("jMaxResolved", "TCRBJ"), ("dMaxResolved", "TCRBD")),
    v="vMaxResolved", d="dMaxResolved", j="jMaxResolved", aa="aminoAcid",
)

BULK = [
    bulk("one", "VGene", "", "JGene", "aaCDR3", "TRAV", "TRBV", chain="file", dropped=DROPPED_ONE, mri_label="bulk_survey"),
    bulk("two", "V alleles", "D alleles", "J alleles", "CDR3 amino acid sequence", "TRAV", "TRBV", chain="file", dropped=DROPPED_TWO),
    bulk("three", "V segments", "D segments", "J segments", "CDR3 amino acid sequence", "TRAV", "TRBV", chain="file", dropped=DROPPED_THREE),
    bulk("four", "v_resolved", "d_resolved", "j_resolved", "amino_acid", "TCRA", "TCRB", IN_FRAME),
    bulk("five", "V_ref", "D_ref", "J_ref", "CDR3(aa)", "TRAV", "TRBV", FUNCTION, more=("#ID", "amino_acid")),
    bulk("six", "vGene", "dGene", "jGene", "aminoAcid(CDR3 in lowercase)", "TRAV", "TRBV", FUNCTION, extra={"longest": "lower"}),
    SEVEN,
    bulk("nine", "v_gene", "d_gene", "j_gene", "amino_acid", "TCRAV", "TCRBV", IN_FRAME),
    bulk("eleven", "v_b_gene", "", "j_b_gene", "cdr3_b_aa", "TRAV", "TRBV"),
]

MISC = [
    Layout("misc_one", ("cdr3s_nt", "cdr3s_aa"), "misc_format", "misc", chain="zipped"),
    Layout("misc_two", ("barcode", "cdr3s_aa"), "misc_format", "misc", chain="lists"),
    Layout("misc_three", ("sample_id", "TR_chain", "subject_id", "CDR3.aa", "V.name", "D.name", "J.name"), "misc_format", "misc", chain="column", v="V.name", d="D.name", j="J.name", aa="CDR3.aa"),
    Layout("misc_four", ("orig.ident", "t_cdr3s_aa", "Unnamed: 0", "Group"), "single_cell", "misc", chain="cells"),
    Layout("misc_five", ("orig.ident", "barcode", "Tissue", "PatientID", "CDR3A", "TRAV", "TRAD", "TRAJ", "CDR3B", "TRBV", "TRBD", "TRBJ"), "misc_format", "misc", chain="wide"),
    Layout("misc_six", ("cdr3aa", "v", "d", "j"), "misc_format", "misc", alpha=(("v", "TRAV"),), beta=(("v", "TRBV"),), v="v", d="d", j="j", aa="cdr3aa"),
]

PAIRED = {
    "contigs": Layout("contigs", ("barcode", "chain", "cdr3", "v_gene", "d_gene", "j_gene", "productive", "high_confidence"), "single_cell", "paired", chain="contigs", keep=(("productive", TRUE), ("high_confidence", TRUE))),
    "clonotypes": Layout("clonotypes", ("cdr3s_aa",), "single_cell", "paired", chain="clonotypes"),
    "airr": Layout("airr", ("cell_id", "is_cell", "productive", "v_call", "d_call", "j_call", "junction_aa"), "single_cell", "paired", chain="rearrangements", keep=(("is_cell", ("T",)), ("productive", ("T",)))),
}


def recognise(columns: list[str], layouts: list[Layout], exact: dict[str, set[str]] | None = None) -> Layout:
    """The layout whose required columns a header has; with exact header sets, the one whose set it is.

    No layout, or several whose required columns aren't nested, is an error: the caller has to name one then.
    """
    header = set(columns)
    if exact is not None:
        fits = [x for x in layouts if exact.get(x.name) == header]
    else:
        fits = [x for x in layouts if set(x.required) <= header]
        fits = [x for x in fits if not any(set(x.required) < set(y.required) for y in fits)]
    if len(fits) != 1:
        raise ValueError(f"{'no layout' if not fits else 'several layouts: ' + ', '.join(x.name for x in fits)} for the columns {sorted(header)}")
    return fits[0]


def paired_layout(file_type: str) -> Layout:
    if file_type not in PAIRED:
        raise ValueError(f"no paired layout is called {file_type}")
    return PAIRED[file_type]


ALPHA = ("trav_gene", "trad_gene", "traj_gene", "tra")
BETA = ("trbv_gene", "trbd_gene", "trbj_gene", "trb")


def _sides(layout: Layout, alpha: Column, beta: Column, aa: Column) -> list[Column]:
    """Columns of both chains, blank on the side that a row isn't."""
    source = [quoted(x) if x else F.lit("") for x in (layout.v, layout.d, layout.j)] + [aa]
    out = []
    for names, here in ((ALPHA, alpha), (BETA, beta)):
        out += [F.when(here, c).otherwise(F.lit("")).alias(n) for c, n in zip(source, names, strict=True)]
    return out


def single_chains(df: DataFrame, layout: Layout) -> DataFrame:
    """Layouts of one chain a row, told by the row or by the file's first row."""
    rows = df
    for name, values in layout.keep:
        rows = rows.filter(quoted(name).isin(*values))
    aa = quoted(layout.aa)
    if layout.extra.get("longest") == "lower":
        aa = longest_lower(aa)
    tells = lambda pairs: contains_any([], "") if not pairs else _any(pairs)
    if layout.chain == "file":
        first = rows.agg(F.min_by(quoted(layout.v), ROW).alias("_first"))
        row = first.first()
        value = row["_first"] if row is not None else None
        if value is None:
            return rows.select(*(F.lit("").alias(n) for n in (*ALPHA, *BETA))).limit(0)
        is_alpha, is_beta = layout.alpha[0][1] in value, layout.beta[0][1] in value
        if not is_alpha and not is_beta:
            raise ValueError(f"the first row's {layout.v} tells no chain: {value}")
        rest = [quoted(c).alias(c) for c in rows.columns if c not in {*layout.dropped, *layout.required, ROW}]
        return rows.select(*_sides(layout, F.lit(is_alpha), F.lit(not is_alpha), aa), *rest)
    alpha, beta = tells(layout.alpha), tells(layout.beta)
    return rows.filter(alpha | beta).select(*_sides(layout, alpha, ~alpha & beta, aa))


def _any(pairs: tuple[tuple[str, str], ...]) -> Column:
    found = F.lit(False)
    for name, text in pairs:
        found = found | F.coalesce(quoted(name).contains(text), F.lit(False))
    return found


def listed_chains(df: DataFrame, layout: Layout) -> DataFrame:
    """Layouts with chain strings in a cell: all pairs of a row's alpha and beta sequences."""
    if layout.chain == "zipped":
        alpha, beta = (chain_zipped(F.col("cdr3s_nt"), F.col("cdr3s_aa"), c) for c in ("TRA", "TRB"))
        tid = F.col(ROW).cast("string")
    else:
        text = F.col("cdr3s_aa" if layout.chain == "lists" else "t_cdr3s_aa")
        df = df.filter(~chain_malformed(text))
        alpha, beta = chain_all(text, "TRA"), chain_all(text, "TRB")
        tid = quoted("barcode" if layout.chain == "lists" else "Unnamed: 0")
    lists = df.select(F.col(ROW), tid.alias("tid"), alpha.alias("al"), beta.alias("be"))
    pairs = pair_arrays(lists, "al", "be", [ROW, "tid"])
    if layout.chain == "cells":
        pairs = pairs.withColumn("tid", F.concat(F.lit("tcr_"), "tid", F.lit("_"), "i"))
    return pairs.select("tid", F.col("a").alias("tra"), F.col("b").alias("trb"))


def set_aside(df: DataFrame, layout: Layout) -> DataFrame:
    """The rows that ``listed_chains`` leaves out, as their chain strings have pieces without a colon: for a count or a report."""
    if layout.chain not in ("lists", "cells"):
        return df.limit(0)
    return df.filter(chain_malformed(F.col("cdr3s_aa" if layout.chain == "lists" else "t_cdr3s_aa")))


def interpret(df: DataFrame, layout: Layout) -> DataFrame:
    """The layout's rows under canonical names, before annotation."""
    if layout.chain in ("row", "file"):
        return single_chains(df, layout)
    if layout.chain in ("zipped", "lists", "cells"):
        return listed_chains(df, layout)
    if layout.chain == "column":
        chain = F.col("TR_chain")
        rest = [c for c in df.columns if c not in {*layout.required, ROW}]
        out = _sides(layout, chain == "TRA", chain == "TRB", quoted(layout.aa))
        return df.filter(chain.isin("TRA", "TRB")).select(*out, *(quoted(c).alias(c) for c in ("sample_id", "subject_id", *rest)))
    if layout.chain == "wide":
        names = {"barcode": "tid", "CDR3A": "tra", "TRAV": "trav_gene", "TRAD": "trad_gene", "TRAJ": "traj_gene", "CDR3B": "trb", "TRBV": "trbv_gene", "TRBD": "trbd_gene", "TRBJ": "trbj_gene"}
        return df.select(*(quoted(c).alias(names[c]) for c in names))
    if layout.chain == "contigs":
        rows = df.filter(F.col("chain").rlike("TR[AB]"))
        for name, values in layout.keep:
            rows = rows.filter(F.col(name).isin(*values))
        return pair_chains(rows, "barcode", ROW, F.col("chain") == "TRA", F.col("chain") == "TRB")
    if layout.chain == "rearrangements":
        rows = df
        for name, values in layout.keep:
            rows = rows.filter(F.col(name).isin(*values))
        calls = [F.col(c) for c in ("v_call", "j_call", "d_call")]
        return pair_chains(rows, "cell_id", ROW, contains_any(calls, "TRA"), contains_any(calls, "TRB"), ("junction_aa", "v_call", "d_call", "j_call"))
    if layout.chain == "clonotypes":
        tid = F.col("barcode") if "barcode" in df.columns else F.col("clonotype_id") if "clonotype_id" in df.columns else F.concat(F.lit("row_index_"), F.col(ROW))
        return df.select(tid.cast("string").alias("tid"), chain_last(F.col("cdr3s_aa"), "TRA").alias("tra"), chain_last(F.col("cdr3s_aa"), "TRB").alias("trb"))
    raise ValueError(f"no rule for layout {layout.name}")


#: Columns left out before sequences are compared.
NOT_COMPARED = {"misc_one": ["tid"], "misc_two": ["tid"], "misc_four": ["tid"], "misc_five": ["tid"]}


def parse_layout(df: DataFrame, layout: Layout, annotations: dict[str, str | Column], dedupe: bool = False, compat_null_tokens: bool = False) -> tuple[DataFrame, DataFrame]:
    """(mri, sequence) of one file's rows, df with an ordinal in the column _row.

    Sequences are distinct over the layout's own columns and projected then, which can leave equal rows; dedupe makes
    the result distinct.
    """
    if layout.kind == "misc":
        df = df.select(*(quoted(c).alias(c) if c == ROW else null_tokens(quoted(c), compat_null_tokens).alias(c) for c in df.columns))
    rows = interpret(df, layout)
    values = {"host_organism": "human", **annotations}
    mri = rows.withColumns({k: v if isinstance(v, Column) else F.lit(v) for k, v in values.items()} | {"source": F.lit(layout.mri_label or layout.label)})
    seq = rows.drop(*NOT_COMPARED.get(layout.name, [])).distinct().withColumn("source", F.lit(layout.label))
    seq = canonical(seq, SEQUENCE)
    return canonical(mri, MRI), seq.distinct() if dedupe else seq


def numbered(df: DataFrame) -> DataFrame:
    """Adds the ordinal, in file order as long as the file is read in one piece or its pieces in order; with gaps between pieces."""
    return df.withColumn(ROW, F.monotonically_increasing_id())


def shows_places(layout: Layout, columns: list[str]) -> bool:
    """Whether the layout's rows are named by their ordinals, so that these mustn't have gaps."""
    return layout.chain == "zipped" or (layout.chain == "clonotypes" and not {"barcode", "clonotype_id"} & set(columns))


def placed(df: DataFrame) -> DataFrame:
    """Adds the ordinal without gaps, from 0, in as many pieces as the file is read in.

    Pieces' sizes are summed up, so no task counts all rows. The rows are written to the shared folder, as another scan
    of the file may be cut into other pieces.
    """
    at = f"{scratch(df.sparkSession, 'placed')}/rows"
    numbered(df).write.parquet(at)
    rows, piece = df.sparkSession.read.parquet(at), F.shiftright(ROW, 33)  # an ordinal with gaps holds the piece above 33 bits
    sizes = rows.groupBy(piece.alias("_piece")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_piece", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    rows = rows.join(F.broadcast(sizes), piece == F.col("_piece"))  # a row for each piece
    return rows.withColumn(ROW, F.col(ROW).bitwiseAND((1 << 33) - 1) + F.col("_before")).drop("_piece", "_before")


def chain_table(df: DataFrame, column: str) -> DataFrame:
    """A row for each entry of a chain string: the flattened form of it."""
    return df.select(*df.columns, F.explode(chain_entries(F.col(column))).alias("entry")).select(*df.columns, "entry.chain", "entry.seq")


def sequence_text(df: DataFrame) -> DataFrame:
    return df.withColumn("sequence", joined_sequence(F.coalesce(or_blank(df, "tra"), F.lit("")), F.coalesce(or_blank(df, "trb"), F.lit(""))))


def no_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return empty(df.sparkSession, MRI), empty(df.sparkSession, SEQUENCE)
