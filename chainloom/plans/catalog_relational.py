"""Queries of relational operators on the supplied tables, each beside its SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.functions.exprs import contains_any, null_tokens, part, prefixed
from chainloom.functions.schema import annotated, canonical, or_blank, renamed
from chainloom.operators import corpus, hla, pairing, stats
from chainloom.plans.databases import union_all, union_distinct, with_metadata
from chainloom.plans.registry import query


def table(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return df.select(*columns) if columns else df


# The power set of order features; one singleton is left out, as the corpus leaves out the lone peptide.
FEATS = ["status", "priority", "cust", "price", "year"]
ORDER_FEATURES = """
  SELECT o_orderkey, o_orderstatus AS status, o_orderpriority AS priority,
    CASE WHEN o_custkey % 10 < 3 THEN 'NA' ELSE 'c' || CAST(o_custkey % 10 AS VARCHAR) END AS cust,
    CASE WHEN o_totalprice < 50000 THEN '' WHEN o_totalprice < 150000 THEN 'mid' ELSE 'high + x' END AS price,
    CAST(year(o_orderdate) AS VARCHAR) AS year
  FROM orders"""


def order_features(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    cust = F.col("o_custkey") % 10
    return o.select(
        "o_orderkey",
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.when(cust < 3, "NA").otherwise(F.concat(F.lit("c"), cust)).alias("cust"),
        F.when(F.col("o_totalprice") < 50000, "").when(F.col("o_totalprice") < 150000, "mid").otherwise("high + x").alias("price"),
        F.year("o_orderdate").cast("string").alias("year"),
    )


def _subset_sql(select: str) -> str:
    arms = []
    for s in corpus.subsets(FEATS, {("cust",)}):
        there = " AND ".join(f"{c} IS NOT NULL AND {c} <> '' AND {c} <> 'NA'" for c in s)
        said = " || ' [SEP] ' || ".join(f"trim(split_part({c}, '+', 1))" if c == "price" else c for c in s)
        arms.append(f"SELECT o_orderkey, {said} AS combo_id, '{'_'.join(sorted(s))}' AS combo FROM f WHERE {there}")
    return f"WITH f AS ({ORDER_FEATURES}), c AS ({' UNION ALL '.join(arms)}) {select}"


@query("combo_counts", _subset_sql("SELECT combo, count(*) AS n FROM c GROUP BY combo"))
def combo_counts(spark: SparkSession, d: str) -> DataFrame:
    return corpus.subset_counts(order_features(spark, d), FEATS, skipped={("cust",)})


@query("power_set", _subset_sql("SELECT o_orderkey, combo_id, combo FROM c"))
def power_set(spark: SparkSession, d: str) -> DataFrame:
    out = corpus.power_set(order_features(spark, d), "bert", FEATS, ["o_orderkey"], {("cust",)})
    return out.select("o_orderkey", "combo_id", F.array_join(F.array_sort("combo_feats"), "_").alias("combo"))


PAIR_SQL = """
WITH a AS (SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)) AS i FROM lineitem WHERE l_returnflag = 'A'),
b AS (SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)) AS j, count(*) OVER (PARTITION BY l_orderkey) AS nb FROM lineitem WHERE l_returnflag = 'N'),
p AS (SELECT coalesce(a.l_orderkey, b.l_orderkey) AS k, a.l_partkey AS pa, b.l_partkey AS pb, (coalesce(i, 1) - 1) * coalesce(nb, 1) + coalesce(j, 1) AS n FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey)
SELECT CAST(k AS VARCHAR) || '_' || CAST(n AS VARCHAR) AS tid, coalesce(CAST(pa AS VARCHAR), '') AS tra, coalesce(CAST(pb AS VARCHAR), '') AS trb,
  trim(coalesce(CAST(pa AS VARCHAR), '') || ' ' || coalesce(CAST(pb AS VARCHAR), '')) || ';' AS sequence FROM p"""


@query("pair_chains", PAIR_SQL)
def pair_chains(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    rows = li.select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("cdr3"), *(F.lit("").alias(x) for x in ("v_gene", "d_gene", "j_gene")), "l_returnflag")
    out = pairing.pair_chains(rows, "l_orderkey", "l_linenumber", F.col("l_returnflag") == "A", F.col("l_returnflag") == "N")
    return out.select("tid", F.coalesce("tra", F.lit("")).alias("tra"), F.coalesce("trb", F.lit("")).alias("trb"), "sequence")


@query(
    "full_outer_pair",
    """SELECT l_orderkey, l_suppkey, a.q AS qa, b.q AS qb
FROM (SELECT l_orderkey, l_suppkey, l_quantity AS q FROM lineitem WHERE l_returnflag = 'R') a
FULL JOIN (SELECT l_orderkey, l_suppkey, l_quantity AS q FROM lineitem WHERE l_returnflag = 'A') b USING (l_orderkey, l_suppkey)""",
)
def full_outer_pair(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_quantity", "l_returnflag")
    side = lambda flag, name: li.filter(F.col("l_returnflag") == flag).select("l_orderkey", "l_suppkey", F.col("l_quantity").alias(name))
    return pairing.full_outer(side("R", "qa"), side("A", "qb"), ["l_orderkey", "l_suppkey"])


@query(
    "inner_pair",
    """SELECT a.l_orderkey, a.l_suppkey, a.l_quantity AS qa, b.l_quantity AS qb FROM lineitem a JOIN lineitem b
ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey AND a.l_returnflag = 'R' AND b.l_returnflag = 'A'""",
)
def inner_pair(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_quantity", "l_returnflag")
    side = lambda flag, name: li.filter(F.col("l_returnflag") == flag).select("l_orderkey", "l_suppkey", F.col("l_quantity").alias(name))
    return pairing.inner(side("R", "qa"), side("A", "qb"), ["l_orderkey", "l_suppkey"])


@query("meta_join", "SELECT l_orderkey, l_linenumber, s_name, n_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey < 3")
def meta_join(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").filter("n_regionkey < 3")
    meta = table(spark, d, "supplier").join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey"))
    meta = meta.select(F.col("s_suppkey").alias("repertoire_id"), "s_name", "n_name")
    obs = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey").withColumnRenamed("l_suppkey", "repertoire_id")
    return with_metadata(meta, obs).select("l_orderkey", "l_linenumber", "s_name", "n_name")


@query(
    "prefix_lookup",
    """WITH a AS (SELECT DISTINCT p_name FROM part), v AS (SELECT p_partkey, left(p_name, 3 + p_size % 5) AS key FROM part)
SELECT v.p_partkey, v.key, (SELECT min(a.p_name) FROM a WHERE starts_with(a.p_name, v.key)) AS first_name FROM v""",
)
def prefix_lookup(spark: SparkSession, d: str) -> DataFrame:
    part_ = table(spark, d, "part", "p_partkey", "p_name", "p_size")
    alleles = part_.select(F.col("p_name").alias("allele")).distinct()
    first = hla.sized(hla.prefixes(alleles))
    keyed = part_.select("p_partkey", F.expr("left(p_name, 3 + p_size % 5)").alias("key"))
    return keyed.join(first, F.col("key") == F.col("prefix"), "left").select("p_partkey", "key", F.col("first_allele").alias("first_name"))


@query("dict_lookup", "SELECT e.event_id, e.user_id, c.c_name FROM events e LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) c ON c.c_custkey = e.user_id")
def dict_lookup(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "customer", "c_custkey", "c_name").filter("c_custkey % 3 <> 0")
    return table(spark, d, "events", "event_id", "user_id").join(hla.sized(names), F.col("user_id") == F.col("c_custkey"), "left").select("event_id", "user_id", "c_name")


@query(
    "distinct_union_missing",
    """SELECT c_name AS name, c_nationkey AS nation, c_mktsegment AS segment, NULL AS bal FROM customer
UNION SELECT s_name, s_nationkey, NULL, s_acctbal FROM supplier UNION SELECT c_name, c_nationkey, c_mktsegment, NULL FROM customer""",
)
def distinct_union_missing(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("bal"))
    return union_distinct([c, s, c])


@query("union_all", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT n_name FROM nation")
def union_all_query(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation").select(F.col("n_name").alias("name")), table(spark, d, "region").select(F.col("r_name").alias("name"))
    return union_all([n, None, r, n])


@query(
    "union_halves",
    """SELECT l_orderkey, CASE WHEN l_returnflag = 'A' THEN CAST(l_partkey AS VARCHAR) ELSE '' END AS tra, CASE WHEN l_returnflag = 'R' THEN CAST(l_partkey AS VARCHAR) ELSE '' END AS trb
FROM lineitem WHERE l_returnflag IN ('A', 'R')""",
)
def union_halves(spark: SparkSession, d: str) -> DataFrame:
    from chainloom.plans.databases import both_loci

    li = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_returnflag")
    locus = F.when(F.col("l_returnflag") == "A", "TRA").when(F.col("l_returnflag") == "R", "TRB")
    rows = li.select(F.col("l_orderkey").cast("string").alias("repertoire_id"), locus.alias("locus"), F.lit("T").alias("productive"), F.col("l_partkey").cast("string").alias("junction_aa"))
    wide = both_loci(rows)
    return wide.select(F.col("repertoire_id").cast("long").alias("l_orderkey"), "tra", "trb")


@query(
    "bulk_observations",
    """WITH x AS (SELECT l_returnflag AS f, CAST(l_suppkey AS VARCHAR) AS v, CAST(l_linenumber AS VARCHAR) AS g FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag IN ('A', 'R'))
SELECT DISTINCT CASE WHEN f = 'A' THEN g ELSE '' END AS trav_gene, '' AS traj_gene, CASE WHEN f = 'A' THEN v ELSE '' END AS tra,
 CASE WHEN f = 'R' THEN g ELSE '' END AS trbv_gene, '' AS trbd_gene, '' AS trbj_gene, CASE WHEN f = 'R' THEN v ELSE '' END AS trb, 'ireceptor_proxy' AS source FROM x""",
)
def bulk_observations_query(spark: SparkSession, d: str) -> DataFrame:
    from chainloom.plans.databases import bulk_observations

    li = table(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")
    rows = li.select(
        F.col("l_orderkey").cast("string").alias("repertoire_id"),
        F.when(F.col("l_returnflag") == "A", "TRA").when(F.col("l_returnflag") == "R", "TRB").otherwise("IGH").alias("locus"),
        F.when(F.col("l_linestatus") == "F", "T").otherwise("F").alias("productive"),
        F.col("l_suppkey").cast("string").alias("junction_aa"),
        F.col("l_linenumber").cast("string").alias("v_call"),
    )
    return bulk_observations(rows, "proxy", dedupe=True)[1]


@query(
    "paired_observations",
    """WITH x AS (SELECT CAST(l_orderkey AS VARCHAR) AS k, CAST(l_suppkey AS VARCHAR) AS c, CAST(l_partkey AS VARCHAR) AS s, l_returnflag AS f FROM lineitem WHERE l_linestatus = 'F')
SELECT k AS repertoire_id, a.s AS tra, b.s AS trb FROM (SELECT * FROM x WHERE f = 'A') a FULL JOIN (SELECT * FROM x WHERE f = 'R') b USING (k, c)""",
)
def paired_observations_query(spark: SparkSession, d: str) -> DataFrame:
    from chainloom.plans.databases import paired_observations

    li = table(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_partkey", "l_returnflag", "l_linestatus")
    rows = li.select(
        F.col("l_orderkey").cast("string").alias("data_processing_id"),
        F.col("l_suppkey").cast("string").alias("cell_id"),
        F.lit("").alias("clone_id"),
        F.when(F.col("l_returnflag") == "A", "TRA").when(F.col("l_returnflag") == "R", "TRB").otherwise("IGH").alias("locus"),
        F.when(F.col("l_linestatus") == "F", "T").otherwise("F").alias("productive"),
        F.col("l_partkey").cast("string").alias("junction_aa"),
        *(F.lit("").alias(c) for c in ("v_call", "d_call", "j_call")),
    )
    return paired_observations(rows, "proxy")[0].select("repertoire_id", "tra", "trb")


@query("canonicalise", "SELECT '' AS source, CAST(c_custkey AS VARCHAR) AS tid, coalesce(c_name, '') AS tra, '' AS peptide, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE CAST(c_nationkey AS VARCHAR) END AS mhc_one FROM customer")
def canonicalise(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    rows = c.select(F.col("c_custkey").alias("tid"), F.col("c_name").alias("tra"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey")).alias("mhc_one"), "c_mktsegment")
    return canonical(rows, ["source", "tid", "tra", "peptide", "mhc_one"])


@query("select_rename", "SELECT p_partkey AS study_id, p_name AS peptide, 'McPAS-TCR' AS data_source, 'PMID' AS study_id_type FROM part")
def select_rename(spark: SparkSession, d: str) -> DataFrame:
    return annotated(renamed(table(spark, d, "part"), {"p_partkey": "study_id", "p_name": "peptide"}), {"data_source": "McPAS-TCR", "study_id_type": "PMID"})


@query("drop_missing", "SELECT * EXCLUDE (c_acctbal), '' AS extra FROM customer")
def drop_missing(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").drop("c_acctbal", "not_there")
    return c.select("*", or_blank(c, "extra"))


@query("replace_literal", "SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE o_orderpriority END AS o_orderpriority, CASE WHEN o_orderstatus = '5-LOW' THEN '' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def replace_literal(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus").replace("5-LOW", "")


@query(
    "null_tokens",
    """WITH p AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'None' WHEN 1 THEN 'NaN' WHEN 2 THEN 'x NA y' WHEN 3 THEN 'N/A' WHEN 4 THEN 'banana' WHEN 5 THEN '' ELSE p_brand END AS b FROM part)
SELECT p_partkey, replace(replace(replace(replace(replace(replace(b, 'None', ''), 'nan', ''), 'NA', ''), 'N/A', ''), 'na', ''), 'NaN', '') AS compat,
CASE WHEN b IN ('None', 'nan', 'NA', 'N/A', 'na', 'NaN') THEN '' ELSE b END AS whole FROM p""",
)
def null_tokens_query(spark: SparkSession, d: str) -> DataFrame:
    said = F.get(F.array(*map(F.lit, ["None", "NaN", "x NA y", "N/A", "banana", ""])), (F.col("p_partkey") % 8).cast("int"))
    b = F.coalesce(said, F.col("p_brand"))
    return table(spark, d, "part", "p_partkey", "p_brand").select("p_partkey", null_tokens(b, compat=True).alias("compat"), null_tokens(b).alias("whole"))


@query(
    "format_case",
    """SELECT p_partkey, CASE WHEN p_type LIKE '%ECONOMY%' THEN p_brand ELSE '' END AS tra, CASE WHEN p_type LIKE '%ECONOMY%' THEN '' ELSE p_brand END AS trb
FROM part WHERE p_type LIKE '%ECONOMY%' OR p_type LIKE '%STANDARD%'""",
)
def format_case(spark: SparkSession, d: str) -> DataFrame:
    from chainloom.plans.formats import ROW, Layout, single_chains

    layout = Layout("proxy", ("p_type",), "proxy", alpha=(("p_type", "ECONOMY"),), beta=(("p_type", "STANDARD"),), v="p_partkey", aa="p_brand")
    rows = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("p_partkey"), "p_type", "p_brand", F.lit(0).alias(ROW))
    out = single_chains(rows, layout)
    key = F.when(F.col("trav_gene") != "", F.col("trav_gene")).otherwise(F.col("trbv_gene")).cast("long")
    return out.select(key.alias("p_partkey"), "tra", "trb")


@query("first_row_detect", "SELECT source, arg_min(lang, doc_id) AS first_lang, min(doc_id) AS first_doc FROM documents GROUP BY source")
def first_row_detect(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "lang", "source")
    return docs.groupBy("source").agg(F.min_by("lang", "doc_id").alias("first_lang"), F.min("doc_id").alias("first_doc"))


@query("filter_equality", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'")
def filter_equality(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").filter((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") != "5-LOW")).select("o_orderkey")


@query("filter_in_list", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_linestatus IN ('F', 'f', 'T')")
def filter_in_list(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").filter(F.col("l_returnflag").isin("A", "R") & F.col("l_linestatus").isin("F", "f", "T")).select("l_orderkey", "l_linenumber")


@query("filter_regex", "SELECT c_custkey, c_mktsegment FROM customer WHERE regexp_matches(c_mktsegment, 'MA[CN]|B[UV]')")
def filter_regex(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").filter(F.col("c_mktsegment").rlike("MA[CN]|B[UV]")).select("c_custkey", "c_mktsegment")


@query("filter_negative_regex", "SELECT p_partkey FROM part WHERE NOT regexp_matches(p_brand, '[13579]$') AND p_type NOT LIKE '%BRASS%'")
def filter_negative_regex(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter(~F.col("p_brand").rlike("[13579]$") & ~F.col("p_type").contains("BRASS")).select("p_partkey")


@query(
    "filter_contains_any",
    """SELECT p_partkey, p_type LIKE '%STEEL%' OR p_name LIKE '%STEEL%' OR p_brand LIKE '%STEEL%' AS is_alpha, p_type LIKE '%A%' OR p_name LIKE '%A%' OR p_brand LIKE '%A%' AS is_beta
FROM part WHERE p_type LIKE '%STEEL%' OR p_name LIKE '%STEEL%' OR p_brand LIKE '%STEEL%' OR p_type LIKE '%A%' OR p_name LIKE '%A%' OR p_brand LIKE '%A%'""",
)
def filter_contains_any(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    calls = [F.col("p_type"), F.col("p_name"), F.col("p_brand")]
    alpha, beta = contains_any(calls, "STEEL"), contains_any(calls, "A")
    return p.filter(alpha | beta).select("p_partkey", alpha.alias("is_alpha"), beta.alias("is_beta"))


@query(
    "filter_protein",
    "SELECT p_partkey, upper(replace(p_name, ' ', '')) AS name FROM part WHERE regexp_full_match(upper(replace(p_name, ' ', '')), '[ACDEFGHIKLMNPQRSTVWY]+')",
)
def filter_protein(spark: SparkSession, d: str) -> DataFrame:
    from chainloom.functions.exprs import is_protein

    p = table(spark, d, "part").select("p_partkey", F.upper(F.replace("p_name", F.lit(" "), F.lit(""))).alias("name"))
    return p.filter(is_protein(F.col("name")))


@query("not_null", "SELECT event_id, event_type FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0 AND value IS NOT NULL")
def not_null(spark: SparkSession, d: str) -> DataFrame:
    from chainloom.functions.exprs import has_feature

    k = F.col("event_id")
    e = table(spark, d, "events").withColumns({"value": F.when(k % 5 != 0, F.col("value")), "event_type": F.when(k % 7 == 0, F.when(k % 2 == 0, "NA").otherwise("")).otherwise(F.col("event_type"))})
    return e.filter(F.col("value").isNotNull() & has_feature(F.col("event_type"))).select("event_id", "event_type")


@query("distinct_subset", "SELECT DISTINCT l_returnflag, l_linestatus, l_suppkey FROM lineitem")
def distinct_subset(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_suppkey").distinct()


@query("first_wins", "SELECT p_brand AS allele, arg_min(p_name, p_partkey) AS protein FROM part GROUP BY p_brand")
def first_wins(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("allele")).agg(F.min_by("p_name", "p_partkey").alias("protein"))


@query(
    "rule_first_match",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 'mask_all' WHEN o_orderpriority = '1-URGENT' THEN 'mask_middle' WHEN o_orderstatus = 'O' THEN 'mask_slice' END AS action FROM orders""",
)
def rule_first_match(spark: SparkSession, d: str) -> DataFrame:
    from chainloom.operators.masking import first_rule, rules_column

    rules = [(["f", "u"], "mask_all"), (["u"], "mask_middle"), (["o", "u"], "mask_middle"), (["p", "u"], "mask_middle"), (["o"], "mask_slice"), (["u", "f"], "never")]
    doc = json.dumps({"masking_rules": [{"if_combo_feats": feats, "action": action, "params": {}} for feats, action in rules]})
    o = table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    feats = F.filter(
        F.array(F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("u")), F.when(F.col("o_orderstatus") == "F", F.lit("f")).when(F.col("o_orderstatus") == "O", F.lit("o")).otherwise(F.lit("p"))),
        lambda x: x.isNotNull(),
    )
    return o.withColumn("feats", feats).select("o_orderkey", first_rule(rules_column(doc), F.col("feats"))["action"].alias("action"))


@query("conditional_prefix", "SELECT page_id, CASE WHEN regexp_extract(url, '([0-9]{2})', 1) = '' THEN NULL ELSE 'CEDAR' || regexp_extract(url, '([0-9]{2})', 1) END AS study_id FROM pages")
def conditional_prefix(spark: SparkSession, d: str) -> DataFrame:
    from chainloom.functions.exprs import digits

    return table(spark, d, "pages", "page_id", "url").select("page_id", prefixed(digits(F.col("url"), 2), "CEDAR").alias("study_id"))


@query("mhc_pair_split", "SELECT c_custkey, c_name AS mhc_one, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS mhc_two FROM customer")
def mhc_pair_split(spark: SparkSession, d: str) -> DataFrame:
    """One part, two parts, and three, of which the third is left out."""
    k = F.col("c_custkey")
    said = F.when(k % 3 == 0, F.col("c_name")).when(k % 3 == 1, F.concat_ws("/", "c_name", "c_mktsegment")).otherwise(F.concat_ws("/", "c_name", "c_mktsegment", "c_name"))
    return table(spark, d, "customer").select("c_custkey", part(said, "/", 1).alias("mhc_one"), part(said, "/", 2).alias("mhc_two"))
