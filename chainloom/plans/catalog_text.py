"""Queries of string, allele and source operators, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.functions import exprs as x
from chainloom.operators import corpus, hla
from chainloom.plans.catalog_relational import table
from chainloom.plans.registry import query
from chainloom.sources.delimited import repertoire_rows

CHAIN_TEXT = """SELECT l_orderkey AS k, string_agg(CASE l_returnflag WHEN 'A' THEN 'TRA' WHEN 'R' THEN 'TRB' ELSE 'x' END || ':' || CAST(l_partkey AS VARCHAR), ';' ORDER BY l_linenumber, l_partkey) AS s FROM lineitem GROUP BY l_orderkey"""


def chain_texts(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    entry = F.concat(F.when(F.col("l_returnflag") == "A", "TRA").when(F.col("l_returnflag") == "R", "TRB").otherwise("x"), F.lit(":"), F.col("l_partkey"))
    rows = li.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", entry.alias("e")))).alias("r"))
    return rows.select("k", F.array_join(F.transform("r", lambda e: e["e"]), ";").alias("s"))


@query(
    "chain_string_last",
    f"""WITH t AS ({CHAIN_TEXT}), e AS (SELECT k, string_split(s, ';') AS p FROM t)
SELECT k, split_part(list_last(list_filter(p, lambda q: split_part(q, ':', 1) = 'TRA')), ':', 2) AS tra, split_part(list_last(list_filter(p, lambda q: split_part(q, ':', 1) = 'TRB')), ':', 2) AS trb FROM e""",
)
def chain_string_last(spark: SparkSession, d: str) -> DataFrame:
    return chain_texts(spark, d).select("k", x.chain_last(F.col("s"), "TRA").alias("tra"), x.chain_last(F.col("s"), "TRB").alias("trb"))


@query(
    "chain_string_all",
    f"""WITH t AS ({CHAIN_TEXT}), e AS (SELECT k, string_split(s, ';') AS p FROM t)
SELECT k, array_to_string(list_transform(list_filter(p, lambda q: split_part(q, ':', 1) = 'TRA'), lambda q: split_part(q, ':', 2)), ',') AS tra,
 CAST(len(list_filter(p, lambda q: split_part(q, ':', 1) = 'TRB')) AS INTEGER) AS n_trb FROM e""",
)
def chain_string_all(spark: SparkSession, d: str) -> DataFrame:
    return chain_texts(spark, d).select("k", F.array_join(x.chain_all(F.col("s"), "TRA"), ",").alias("tra"), F.size(x.chain_all(F.col("s"), "TRB")).alias("n_trb"))


@query(
    "split_explode_outer",
    """SELECT conv_id, turn, part FROM (SELECT conv_id, turn, unnest(CASE WHEN text = '' OR text IS NULL THEN [NULL] ELSE string_split(text, '.') END) AS part FROM conversations)""",
)
def split_explode_outer(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations", "conv_id", "turn", "text")
    return c.select("conv_id", "turn", F.explode_outer(x.split_or_none(F.col("text"), r"\.")).alias("part"))


@query("regex_extract_prefix", "SELECT page_id, CASE WHEN regexp_extract(url, '([0-9]{3})', 1) = '' THEN NULL ELSE 'IEDB' || regexp_extract(url, '([0-9]{3})', 1) END AS study_id FROM pages")
def regex_extract_prefix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages", "page_id", "url").select("page_id", x.prefixed(x.digits(F.col("url"), 3), "IEDB").alias("study_id"))


@query(
    "longest_run",
    """SELECT item_id, list_reduce(list_concat([''], regexp_extract_all(text, '[a-z]+')), lambda a, v: CASE WHEN length(v) > length(a) THEN v ELSE a END) AS run FROM benchmark""",
)
def longest_run(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", x.longest_lower(F.col("text")).alias("run"))


@query("char_space", "SELECT p_partkey, array_to_string(list_filter(string_split(p_name, ''), lambda c: c <> ''), ' ') AS spaced FROM part")
def char_space(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part", "p_partkey", "p_name").select("p_partkey", x.spaced(F.col("p_name")).alias("spaced"))


@query(
    "tag_features",
    r"""WITH p AS (SELECT p_partkey, upper(replace(p_name, ' ', '')) AS tra, upper(split_part(p_type, ' ', 1)) AS trb, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN '' ELSE 'ACD' END AS peptide FROM part)
SELECT p_partkey, array_to_string(list_filter([
 CASE WHEN regexp_full_match(tra, '[ACDEFGHIKLMNPQRSTVWY]+') THEN '[TRA] ' || array_to_string(string_split(tra, ''), ' ') || ' [ETRA]' END,
 CASE WHEN regexp_full_match(trb, '[ACDEFGHIKLMNPQRSTVWY]+') THEN '[TRB] ' || array_to_string(string_split(trb, ''), ' ') || ' [ETRB]' END,
 CASE WHEN regexp_full_match(peptide, '[ACDEFGHIKLMNPQRSTVWY]+') THEN '[PEP] ' || array_to_string(string_split(peptide, ''), ' ') || ' [EPEP]' END], lambda t: t IS NOT NULL), '|') AS tagged FROM p""",
)
def tag_features(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    rows = p.select("p_partkey", F.upper(F.replace("p_name", F.lit(" "), F.lit(""))).alias("tra"), F.upper(F.split_part("p_type", F.lit(" "), F.lit(1))).alias("trb"), F.when(F.col("p_size") % 3 == 1, "NA").when(F.col("p_size") % 3 == 2, "ACD").alias("peptide"))
    #: "NA" is made of letters of amino acids, but says that a value is missing.
    rows = rows.withColumn("peptide", F.when(F.col("peptide") != "NA", F.col("peptide")))
    return rows.select("p_partkey", F.array_join(corpus.tagged(rows), "|").alias("tagged"))


@query(
    "allele_normalise",
    r"""WITH v AS (SELECT unnest(['HLA-A*02:01', 'HLA-A2', 'A*2:1', 'HLA-A*2', 'A01:01', 'A*02:10', 'A*02:101', 'C*99', 'A*02:01:01', 'HLA-A*02:01 K66A mutant', 'HLA-A*02:01 K66A, E163Q mutant', 'HLA-DRB1*04', 'HLA-DPB1', 'HLA-E*01:03', 'HLA-B7', '', 'HLA class I']) AS value),
b AS (SELECT value, trim(regexp_replace(value, '\s+([A-Za-z0-9, ]+)\s+mutant$', '')) AS t FROM v),
h AS (SELECT value, replace(CASE WHEN starts_with(t, 'HLA-') THEN replace(t, 'HLA-', '') ELSE t END, '-', ':') AS t FROM b)
SELECT value, CASE WHEN regexp_matches(t, '^[ABC]\*?\d{1,2}$') THEN regexp_replace(regexp_replace(t, '^([ABC])(\d{1,2})$', '\1*\2'), '([ABC])\*(\d)$', '\1*0\2')
 WHEN regexp_matches(t, '^[ABC]\*?\d{1,2}:\d{1,2}$') THEN regexp_replace(regexp_replace(t, '([ABC])\*(\d):(\d{1,2})$', '\1*0\2:\3'), '([ABC])\*(\d{2}):(\d)$', '\1*\2:0\3') ELSE t END AS name FROM h""",
)
def allele_normalise(spark: SparkSession, d: str) -> DataFrame:
    values = ["HLA-A*02:01", "HLA-A2", "A*2:1", "HLA-A*2", "A01:01", "A*02:10", "A*02:101", "C*99", "A*02:01:01", "HLA-A*02:01 K66A mutant", "HLA-A*02:01 K66A, E163Q mutant", "HLA-DRB1*04", "HLA-DPB1", "HLA-E*01:03", "HLA-B7", "", "HLA class I"]
    df = spark.createDataFrame([(v,) for v in values], "value string")
    return df.select("value", hla.normalised(F.col("value")).alias("name"))


RESOLVED = """WITH a AS (SELECT unnest(['A*01:01', 'A*02:01', 'A*02:101', 'B*07:02', 'DRA*01:01', 'DRB1*04:01', 'DPB1*01:01', 'E*01:03']) AS allele),
p AS (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'HLA-A2' WHEN 1 THEN 'A*02:10' WHEN 2 THEN 'HLA-B*07:02 K66A mutant' WHEN 3 THEN 'HLA-DRB1*04' WHEN 4 THEN 'C*99' ELSE '' END AS value,
 CASE p_size % 6 WHEN 0 THEN 'A*02' WHEN 1 THEN 'A*02:10' WHEN 2 THEN 'B*07:02' WHEN 3 THEN 'DRB1*04' WHEN 4 THEN 'C*99' END AS key FROM part),
r AS (SELECT p_partkey, value, (SELECT min(allele) FROM a WHERE starts_with(allele, key)) || CASE WHEN p_partkey IS NOT NULL AND value LIKE '%mutant' THEN '_mK66A' ELSE '' END AS mhc_id FROM p)
SELECT p_partkey, value, mhc_id, CASE WHEN mhc_id IN (SELECT allele FROM a) THEN 'protein of ' || mhc_id END AS protein FROM r"""


@query("allele_resolve", RESOLVED)
def allele_resolve(spark: SparkSession, d: str) -> DataFrame:
    names = ["A*01:01", "A*02:01", "A*02:101", "B*07:02", "DRA*01:01", "DRB1*04:01", "DPB1*01:01", "E*01:03"]
    alleles = spark.createDataFrame([(n, f"protein of {n}") for n in names], "allele string, protein string")
    values = ["HLA-A2", "A*02:10", "HLA-B*07:02 K66A mutant", "HLA-DRB1*04", "C*99", ""]
    value = F.get(F.array(*map(F.lit, values)), F.col("p_size") % 6)
    return hla.resolve(table(spark, d, "part").select("p_partkey", value.alias("value")), alleles, "value", "mhc_id", "protein")


LEGACY_SQL = """WITH a AS (SELECT unnest(['A*01:01', 'A*02:03', 'A*02:101', 'B*07:02']) AS allele),
v AS (SELECT p_partkey, list_extract(['HLA-B*7:2', 'HLA-A2', 'HLA-B8', 'HLA-DPB1*2:1', 'HLA-DRB1*15:01', 'HLA-DRB1*03', 'HLA-DPB1', 'HLA-E*01:03', 'B*7:2', 'HLA class I', '', NULL], CAST(1 + p_partkey % 12 AS INTEGER)) AS value FROM part),
k AS (SELECT *, CASE WHEN regexp_matches(value, '^HLA-[ABC][0-9]{1,2}$') THEN substr(value, 5, 1) || '*' || lpad(substr(value, 6), 2, '0') END AS key FROM v)
SELECT p_partkey, value, CASE WHEN key IS NOT NULL THEN coalesce((SELECT min(allele) FROM a WHERE starts_with(allele, key)), key || ':01')
 WHEN value IN ('HLA-B*7:2', 'HLA-DPB1*2:1', 'HLA-DRB1*15:01', 'HLA-E*01:03') THEN replace(value, 'HLA-', '') WHEN value = 'HLA-DRB1*03' THEN 'DRB1*03:01' WHEN value = 'HLA-DPB1' THEN 'DPB1*01:01' ELSE value END AS name FROM k"""


@query("allele_legacy", LEGACY_SQL)
def allele_legacy(spark: SparkSession, d: str) -> DataFrame:
    alleles = spark.createDataFrame([("A*01:01",), ("A*02:03",), ("A*02:101",), ("B*07:02",)], "allele string")
    values = ["HLA-B*7:2", "HLA-A2", "HLA-B8", "HLA-DPB1*2:1", "HLA-DRB1*15:01", "HLA-DRB1*03", "HLA-DPB1", "HLA-E*01:03", "B*7:2", "HLA class I", ""]
    value = F.get(F.array(*map(F.lit, values)), (F.col("p_partkey") % 12).cast("int"))
    return hla.legacy_resolve(table(spark, d, "part").select("p_partkey", value.alias("value")), alleles, "value", "name")


@query("allele_two_fields", "SELECT event_id, array_to_string(list_slice(string_split(CAST(ts AS VARCHAR), ':'), 1, 2), ':') AS allele FROM events")
def allele_two_fields(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events", "event_id", "ts").select("event_id", x.two_fields(F.col("ts").cast("string")).alias("allele"))


@query("mhc_restriction_split", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_brand WHEN p_size % 3 = 2 THEN 'DRA' END AS alpha, CASE WHEN p_size % 3 = 1 THEN 'DRB' || p_brand WHEN p_size % 3 = 2 THEN 'DRB1' END AS beta FROM part")
def mhc_restriction_split(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part", "p_partkey", "p_brand", "p_size")
    value = F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).when(F.col("p_size") % 3 == 1, F.concat(F.lit("DRB"), "p_brand")).otherwise("DRA/DRB1")
    alpha, beta = hla.restriction_pair(value)
    return p.select("p_partkey", alpha.alias("alpha"), beta.alias("beta"))


@query(
    "json_nav",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'p' || CAST(event_id AS VARCHAR) WHEN 1 THEN CAST(json_extract_string(props, '$.k') AS VARCHAR) ELSE '' END AS page FROM events""",
)
def json_nav(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    props = F.when(k % 3 == 0, F.concat(F.lit('{"a": {"page": "p'), k, F.lit('"}, "k": 1}'))).when(k % 3 == 1, F.col("props")).otherwise("{}")
    return table(spark, d, "events", "event_id", "props").select("event_id", x.json_value(props, "$.a.page", "$.k").alias("page"))


@query(
    "repertoire_metadata",
    """SELECT DISTINCT 's' || CAST(c_nationkey AS VARCHAR) AS study_id, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE CAST(c_custkey AS VARCHAR) END AS repertoire_id, c_mktsegment AS host_organism,
 CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN 'group' ELSE 'group ill' END AS condition_studies, CASE WHEN c_custkey % 2 = 0 THEN 'A*01:01,B*07:02' ELSE '' END AS mhc_profile FROM customer""",
)
def repertoire_metadata(spark: SparkSession, d: str) -> DataFrame:
    doc = """named_struct('repertoire_id', 'r', 'study', named_struct('study_id', concat('s', c_nationkey)),
 'data_processing', if(c_custkey % 4 = 0, null, array(named_struct('data_processing_id', string(c_custkey)))),
 'subject', named_struct('age', string(null), 'sex', string(null), 'race', string(null), 'species', named_struct('label', c_mktsegment),
  'diagnosis', if(c_custkey % 3 = 0, null, array(named_struct('study_group_description', 'group', 'disease_diagnosis', named_struct('label', if(c_custkey % 3 = 1, string(null), 'ill'))))),
  'genotype', named_struct('mhc_genotype_set', named_struct('mhc_genotype_list', if(c_custkey % 2 = 0, array(named_struct('mhc_alleles', array(named_struct('allele_designation', 'B*07:02'), named_struct('allele_designation', 'A*01:01'), named_struct('allele_designation', 'B*07:02')))), null)))),
 'sample', array(named_struct('tissue', named_struct('label', string(null)))))"""
    rows = table(spark, d, "customer").select(F.expr(doc).alias("r"))
    return repertoire_rows(rows).select("study_id", "repertoire_id", "host_organism", "condition_studies", "mhc_profile").distinct()


@query("joined_sequence", "SELECT o_orderkey, CASE WHEN a = '' AND b = '' THEN '' ELSE trim(a || ' ' || b) || ';' END AS sequence FROM (SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN '' ELSE o_orderstatus END AS a, CASE WHEN o_custkey % 2 = 0 THEN '' ELSE 'x' END AS b FROM orders)")
def joined_sequence(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    a, b = F.when(F.col("o_custkey") % 3 == 0, "").otherwise(F.col("o_orderstatus")), F.when(F.col("o_custkey") % 2 == 0, "").otherwise("x")
    return o.select("o_orderkey", x.joined_sequence(a, b).alias("sequence"))


@query("starless_sequence", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END || CASE WHEN p_size % 2 = 0 AND p_size % 5 <> 0 THEN ' ' ELSE '' END || CASE WHEN p_size % 5 <> 0 THEN p_name ELSE '' END || ';' AS sequence FROM part")
def starless_sequence(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    values = [F.when(F.col("p_size") % 2 == 0, F.col("p_brand")), F.when(F.col("p_size") % 5 == 0, "C*SS").otherwise(F.col("p_name"))]
    return p.select("p_partkey", x.starless_sequence(values).alias("sequence"))


@query("first_peptide", "SELECT page_id, split_part(replace(url, '/', ' + '), '+', 1) AS raw, trim(split_part(replace(url, '/', ' + '), '+', 1)) AS stripped FROM pages")
def first_peptide(spark: SparkSession, d: str) -> DataFrame:
    text = F.replace("url", F.lit("/"), F.lit(" + "))
    return table(spark, d, "pages", "page_id", "url").select("page_id", x.first_peptide(text).alias("raw"), x.first_peptide(text, strip=True).alias("stripped"))


@query("no_white", r"SELECT item_id, regexp_replace(text, '[ \t\n\r\f\v]+', '', 'g') AS text FROM benchmark")
def no_white(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", x.no_white(F.col("text")).alias("text"))


@query("shortened", "SELECT doc_id, CASE WHEN length(text) > 50 THEN left(text, 50) || '...' ELSE text END AS text FROM documents")
def shortened(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", x.shortened(F.col("text")).alias("text"))


@query(
    "zip_chains",
    """SELECT l_orderkey AS k, count(*) FILTER (WHERE l_returnflag = 'A') AS n_tra, coalesce(string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey, 'TRA:' || CAST(l_suppkey AS VARCHAR)) FILTER (WHERE l_returnflag = 'A'), '') AS tra FROM lineitem GROUP BY l_orderkey""",
)
def zip_chains(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    chain = F.when(F.col("l_returnflag") == "A", "TRA").otherwise("TRB")
    rows = li.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.concat(chain, F.lit(":nt")).alias("nt"), F.concat(chain, F.lit(":"), "l_suppkey").alias("aa")))).alias("r"))
    nt, aa = (F.array_join(F.col(f"r.{n}"), ";") for n in ("nt", "aa"))
    tra = x.chain_zipped(nt, aa, "TRA")
    return rows.select("k", F.size(tra).cast("long").alias("n_tra"), F.array_join(tra, ",").alias("tra"))


@query("path_columns", "SELECT page_id, split_part(string_split(url, '/')[-1], '.', 1) = '' AS bare, coalesce(string_split(url, '/')[-2], '') AS study_id, coalesce(string_split(url, '/')[-3], '') AS category FROM pages")
def path_columns(spark: SparkSession, d: str) -> DataFrame:
    parts = F.split("url", "/")
    up = lambda k: F.coalesce(F.try_element_at(parts, F.lit(-k)), F.lit(""))
    return table(spark, d, "pages", "page_id", "url").select("page_id", (F.split_part(up(1), F.lit("."), F.lit(1)) == "").alias("bare"), up(2).alias("study_id"), up(3).alias("category"))
