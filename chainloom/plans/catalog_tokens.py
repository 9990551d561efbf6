"""Queries of splits, token arrays, masking, metrics and statistics, each beside its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.operators import corpus, masking, metrics, stats, tokens
from chainloom.plans.catalog_relational import table
from chainloom.plans.registry import query

# Token arrays for the queries: code points of one to four times a part's name, less 95, so that letters are 2 to 27; the
# key is p_partkey. Lengths lie on both sides of every limit that the queries set.
IDS_SQL = "SELECT p_partkey, list_transform(list_filter(string_split(replace(repeat(p_name, 1 + p_partkey % 4), ' ', ''), ''), lambda c: c <> ''), lambda c: CAST(ascii(c) - 95 AS INTEGER)) AS ids FROM part"


def ids(spark: SparkSession, d: str) -> DataFrame:
    name = F.repeat("p_name", (1 + F.col("p_partkey") % 4).cast("int"))
    chars = F.filter(F.split(F.replace(name, F.lit(" "), F.lit("")), ""), lambda c: c != "")
    return table(spark, d, "part", "p_partkey", "p_name").select("p_partkey", F.transform(chars, lambda c: F.ascii(c) - 95).alias("ids"))


def shown(df: DataFrame, **columns: F.Column) -> DataFrame:
    """p_partkey and arrays as text; arrays are named in a step of their own, so that none stands for another's input."""
    made = df.select("p_partkey", *(c.alias(f"_{n}") for n, c in columns.items()))
    return made.select("p_partkey", *(text(F.col(f"_{n}")).alias(n) for n in columns))


def text(c: F.Column) -> F.Column:
    return F.array_join(F.transform(c, lambda t: t.cast("string")), " ")


def sql_text(c: str) -> str:
    return f"array_to_string(list_transform({c}, lambda t: CAST(t AS VARCHAR)), ' ')"


@query(
    "exact_split",
    """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS r, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN r <= round(n * 0.1) THEN 'test' WHEN r <= round(n * 0.1) + round(n * 0.1) THEN 'val' ELSE 'train' END AS split FROM r""",
)
def exact_split(spark: SparkSession, d: str) -> DataFrame:
    return corpus.exact_split(table(spark, d, "documents", "doc_id"), "doc_id")


@query("hash_split", "SELECT doc_id, CASE WHEN h < 0.1 THEN 'test' WHEN h < 0.2 THEN 'val' ELSE 'train' END AS split FROM (SELECT doc_id, CAST('0x' || left(md5('42:' || CAST(doc_id AS VARCHAR)), 8) AS BIGINT) / 4294967296.0 AS h FROM documents)")
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    return corpus.hash_split(table(spark, d, "documents", "doc_id"), "doc_id")


@query(
    "shard_contiguous",
    """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS n FROM documents)
SELECT doc_id, CAST(least(r // greatest(n // 8, 1), 7) AS INTEGER) AS shard FROM r""",
)
def shard_contiguous(spark: SparkSession, d: str) -> DataFrame:
    return corpus.contiguous_shards(table(spark, d, "documents", "doc_id"), "doc_id", 8)


@query("topk_shuffled", "SELECT doc_id, lang FROM documents ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100")
def topk_shuffled(spark: SparkSession, d: str) -> DataFrame:
    return corpus.take_shuffled(table(spark, d, "documents", "doc_id", "lang"), "doc_id", 100)


@query("sort_length", "SELECT doc_id, CAST(len(string_split(text, ' ')) AS INTEGER) AS n FROM documents ORDER BY n")
def sort_length(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.split("text", " ").alias("input_ids"))
    return corpus.by_length(words).select("doc_id", F.size("input_ids").alias("n"))


@query("row_sample")
def row_sample(spark: SparkSession, d: str) -> DataFrame:
    return corpus.sampled(table(spark, d, "lineitem", "l_orderkey", "l_linenumber"), 0.1)


@query("token_totals", "SELECT lang AS split, count(*) AS n_rows, CAST(sum(len(list_filter(string_split(text, ' '), lambda w: w <> ''))) AS BIGINT) AS n_tokens FROM documents GROUP BY lang")
def token_totals(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents", "lang", "text").select(F.col("lang").alias("split"), F.filter(F.split("text", " "), lambda w: w != "").alias("input_ids"))
    return stats.token_totals(words)


VOCAB = """WITH w AS (SELECT unnest(string_split(p_name || ' ' || p_type, ' ')) AS word FROM part),
v AS (SELECT word, 2 + row_number() OVER (ORDER BY count(*) DESC, word) - 1 AS id FROM w WHERE word <> '' GROUP BY word QUALIFY row_number() OVER (ORDER BY count(*) DESC, word) <= 10)"""


@query(
    "vocab_encode",
    f"""{VOCAB}, t AS (SELECT p_partkey, unnest(string_split(p_name || ' ' || p_type, ' ')) AS word, generate_subscripts(string_split(p_name || ' ' || p_type, ' '), 1) AS i FROM part)
SELECT p_partkey, string_agg(CAST(coalesce(v.id, 1) AS VARCHAR), ' ' ORDER BY i) AS ids FROM t LEFT JOIN v ON v.word = t.word GROUP BY p_partkey""",
)
def vocab_encode(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part", "p_partkey", "p_name", "p_type").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("p_type"))
    vocab = tokens.vocabulary(p, F.col("p_type"), 12, [tokens.PAD, tokens.UNK])
    return p.select("p_partkey", text(tokens.encode(F.col("p_type"), tokens.vocabulary_map(vocab), vocab[tokens.UNK])).alias("ids"))


@query(
    "token_decode",
    f"""{VOCAB}, t AS (SELECT p_partkey, unnest(string_split(p_name || ' ' || p_type, ' ')) AS word, generate_subscripts(string_split(p_name || ' ' || p_type, ' '), 1) AS i FROM part)
SELECT p_partkey, string_agg(coalesce(v.word, '[UNK]'), ' ' ORDER BY i) AS text FROM t LEFT JOIN v ON v.word = t.word GROUP BY p_partkey""",
)
def token_decode(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part", "p_partkey", "p_name", "p_type").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("p_type"))
    vocab = tokens.vocabulary(p, F.col("p_type"), 12, [tokens.PAD, tokens.UNK])
    words = tokens.vocabulary_map(vocab)
    return p.select("p_partkey", tokens.decode(tokens.encode(F.col("p_type"), words, vocab[tokens.UNK]), tokens.inverted(words)).alias("text"))


@query(
    "pad_shift",
    f"""WITH t AS ({IDS_SQL}), f AS (SELECT p_partkey, list_resize(list_slice(ids, 1, 12), 12, 0) AS a FROM t)
SELECT p_partkey, {sql_text("list_resize(list_slice(a, 1, 11), 12, 0)")} AS x, {sql_text("list_resize(list_slice(a, 2, 12), 12, 0)")} AS y FROM f""",
)
def pad_shift(spark: SparkSession, d: str) -> DataFrame:
    a, b = tokens.shifted(F.col("ids"), 12)
    return ids(spark, d).select("p_partkey", text(a).alias("x"), text(b).alias("y"))


@query(
    "pad_shift_long",
    f"""WITH t AS ({IDS_SQL}), f AS (SELECT p_partkey, CASE WHEN len(ids) > 12 THEN ids ELSE list_resize(ids, 12, 0) END AS a FROM t)
SELECT p_partkey, {sql_text("list_resize(list_slice(list_slice(a, 1, len(a) - 1), 1, 12), 12, 0)")} AS x, {sql_text("list_resize(list_slice(list_slice(a, 2, len(a)), 1, 12), 12, 0)")} AS y FROM f""",
)
def pad_shift_long(spark: SparkSession, d: str) -> DataFrame:
    a, b = tokens.shifted(F.col("ids"), 12, truncate=False)
    return ids(spark, d).select("p_partkey", text(a).alias("x"), text(b).alias("y"))


@query(
    "sliding_windows",
    f"""WITH t AS ({IDS_SQL}), n AS (SELECT p_partkey, ids, CASE WHEN len(ids) < 9 THEN 1 ELSE (len(ids) - 9) // 3 + 1 END AS n FROM t),
w AS (SELECT p_partkey, CASE WHEN len(ids) < 9 THEN list_resize(ids, 9, 0) ELSE list_slice(ids, i * 3 + 1, i * 3 + 9) END AS a FROM n, generate_series(0, 40) g(i) WHERE i < n.n)
SELECT p_partkey, {sql_text("list_slice(a, 1, 8)")} AS x, {sql_text("list_slice(a, 2, 9)")} AS y FROM w""",
)
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    w = ids(spark, d).select("p_partkey", F.explode(tokens.windows(F.col("ids"), 8, 3)).alias("w"))
    return w.select("p_partkey", text(F.col("w.x")).alias("x"), text(F.col("w.y")).alias("y"))


@query("attention_mask", f"WITH t AS ({IDS_SQL}) SELECT p_partkey, {sql_text('list_transform(list_resize(list_slice(ids, 1, 16), 16, 0), lambda t: CASE WHEN t = 0 THEN 0 ELSE 1 END)')} AS mask FROM t")
def attention_mask(spark: SparkSession, d: str) -> DataFrame:
    return ids(spark, d).select("p_partkey", text(tokens.attention_mask(tokens.padded(F.col("ids"), 16))).alias("mask"))


@query(
    "batch_padding",
    f"WITH t AS ({IDS_SQL}), b AS (SELECT p_partkey, ids, max(len(ids)) OVER (PARTITION BY p_partkey // 100) AS m FROM t) SELECT p_partkey, {sql_text('list_resize(ids, m, 0)')} AS ids, CAST(len(ids) AS INTEGER) AS n_real FROM b",
)
def batch_padding(spark: SparkSession, d: str) -> DataFrame:
    rows = ids(spark, d).withColumn("batch", F.floor(F.col("p_partkey") / 100))
    out = tokens.batch_padded(rows, "batch", "ids")
    return out.select("p_partkey", text(F.col("ids")).alias("ids"), F.aggregate("attention_mask", F.lit(0), lambda a, t: a + t).alias("n_real"))


MIDDLE = """SELECT p_partkey, ids, len(ids) // 2 - 1 AS s, len(ids) // 2 + 2 AS e FROM t"""


def mask_sql(bounds: str) -> str:
    return f"""WITH t AS ({IDS_SQL}), b AS ({bounds}), g AS (SELECT p_partkey, ids, CASE WHEN s >= 0 AND s < e AND e <= len(ids) THEN s ELSE 0 END AS s, CASE WHEN s >= 0 AND s < e AND e <= len(ids) THEN e ELSE 0 END AS e FROM b)
SELECT p_partkey, {sql_text("list_transform(ids, lambda t, i: CASE WHEN i > s AND i <= e THEN 1 ELSE t END)")} AS ids, {sql_text("list_transform(ids, lambda t, i: CASE WHEN i > s AND i <= e THEN t ELSE -100 END)")} AS labels FROM g"""


def mask_query(spark: SparkSession, d: str, action: str, **params: int) -> DataFrame:
    struct = F.from_json(F.lit("{}"), "num_tokens int, start_index int, end_index int")
    values = F.struct(*(F.lit(params.get(k)).cast("int").alias(k) for k in ("num_tokens", "start_index", "end_index"))) if params else struct
    rule = F.struct(F.lit(action).alias("action"), values.alias("params"))
    rows = ids(spark, d).withColumn("rule", rule)
    a, b = masking.by_rule(F.col("ids"), F.col("rule"), 1)
    return shown(rows, ids=a, labels=b)


@query("mask_middle", mask_sql(MIDDLE))
def mask_middle(spark: SparkSession, d: str) -> DataFrame:
    return mask_query(spark, d, "mask_middle", num_tokens=3)


@query("mask_slice", mask_sql("SELECT p_partkey, ids, 5 AS s, 20 AS e FROM t"))
def mask_slice(spark: SparkSession, d: str) -> DataFrame:
    return mask_query(spark, d, "mask_slice", start_index=5, end_index=20)


@query("mask_all", mask_sql("SELECT p_partkey, ids, 0 AS s, len(ids) AS e FROM t"))
def mask_all(spark: SparkSession, d: str) -> DataFrame:
    return mask_query(spark, d, "mask_everything")


@query(
    "mask_random",
    f"""WITH t AS ({IDS_SQL}), e AS (SELECT p_partkey, unnest(ids) AS t, generate_subscripts(ids, 1) - 1 AS i FROM t),
r AS (SELECT p_partkey, t, i, row_number() OVER (PARTITION BY p_partkey ORDER BY md5('42:' || CAST(p_partkey AS VARCHAR) || ':' || CAST(i AS VARCHAR)), i) AS r, count(*) OVER (PARTITION BY p_partkey) AS n FROM e WHERE t NOT IN (2, 20)),
m AS (SELECT p_partkey, i FROM r WHERE r <= greatest(1, round_even(n * 0.15, 0)))
SELECT e.p_partkey, string_agg(CAST(CASE WHEN m.i IS NULL THEN e.t ELSE 1 END AS VARCHAR), ' ' ORDER BY e.i) AS ids, string_agg(CAST(CASE WHEN m.i IS NULL THEN -100 ELSE e.t END AS VARCHAR), ' ' ORDER BY e.i) AS labels
FROM e LEFT JOIN m ON m.p_partkey = e.p_partkey AND m.i = e.i GROUP BY e.p_partkey""",
)
def mask_random(spark: SparkSession, d: str) -> DataFrame:
    a, b = masking.at_random(F.col("ids"), F.col("p_partkey"), 0.15, 1, [2, 20])
    return shown(ids(spark, d), ids=a, labels=b)


@query("mask_dynamic")
def mask_dynamic(spark: SparkSession, d: str) -> DataFrame:
    a, b = masking.dynamic(F.col("ids"), F.col("p_partkey"), 0.15, 1, 28, [2, 20])
    return shown(ids(spark, d), ids=a, labels=b)


@query(
    "mask_restore",
    f"WITH t AS ({IDS_SQL}) SELECT p_partkey, {sql_text('ids')} AS original, {sql_text('list_transform(ids, lambda t, i: CASE WHEN i > 2 AND i <= 5 AND len(ids) >= 5 THEN t + 1 ELSE t END)')} AS predicted FROM t",
)
def mask_restore(spark: SparkSession, d: str) -> DataFrame:
    rule = F.struct(F.lit("mask_slice").alias("action"), F.struct(F.lit(3).alias("num_tokens"), F.lit(2).alias("start_index"), F.lit(5).alias("end_index")).alias("params"))
    a, b = masking.by_rule(F.col("ids"), F.col("rule"), 1)
    rows = ids(spark, d).withColumn("rule", rule).select("p_partkey", a.alias("masked"), b.alias("labels"), F.transform("ids", lambda t: t + 1).alias("preds"))
    masked, labels = tokens.padded(F.col("masked"), 64), F.concat("labels", F.array_repeat(F.lit(masking.IGNORED), 64 - F.size("labels")))
    preds = tokens.padded(F.col("preds"), 64)
    return rows.select("p_partkey", text(masking.restored(masked, labels, 0)).alias("original"), text(masking.filled(masked, labels, preds, 0)).alias("predicted"))


# Labels and predictions for the metrics: ids, and ids with every third one changed; every fifth label is ignored.
def judged(spark: SparkSession, d: str) -> DataFrame:
    return ids(spark, d).select("p_partkey", F.transform("ids", lambda t, i: F.when(i % 5 == 4, F.lit(-100)).otherwise(t)).alias("labels"), F.transform("ids", lambda t, i: F.when((i + F.col("p_partkey")) % 3 == 0, t + 1).otherwise(t)).cast("array<int>").alias("preds"))


JUDGED = f"""WITH t AS ({IDS_SQL}), e AS (SELECT p_partkey, unnest(ids) AS t, generate_subscripts(ids, 1) - 1 AS i FROM t),
j AS (SELECT p_partkey, i, CASE WHEN i % 5 = 4 THEN -100 ELSE t END AS label, CASE WHEN (i + p_partkey) % 3 = 0 THEN t + 1 ELSE t END AS pred FROM e)"""


@query("masked_accuracy", f"{JUDGED} SELECT count(*) FILTER (WHERE label = pred) AS correct, count(*) AS total, round(CAST(count(*) FILTER (WHERE label = pred) AS DOUBLE) / count(*), 9) AS accuracy FROM j WHERE label <> -100")
def masked_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return metrics.masked_accuracy(judged(spark, d)).withColumn("accuracy", F.round("accuracy", 9))


@query("example_accuracy", f"{JUDGED} SELECT p_partkey, round(coalesce(CAST(count(*) FILTER (WHERE label <> -100 AND label = pred) AS DOUBLE) / nullif(count(*) FILTER (WHERE label <> -100), 0), 1), 9) AS accuracy FROM j GROUP BY p_partkey")
def example_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).select("p_partkey", F.round(metrics.example_accuracy(F.col("labels"), F.col("preds")), 9).alias("accuracy"))


@query("token_accuracy", f"{JUDGED} SELECT round(avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END), 9) AS accuracy_with_pads, round(CAST(count(*) FILTER (WHERE label <> 2 AND label = pred) AS DOUBLE) / count(*) FILTER (WHERE label <> 2), 9) AS accuracy FROM j")
def token_accuracy(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.token_accuracy(judged(spark, d), "labels", "preds", 2)
    return out.select(*(F.round(c, 9).alias(c) for c in out.columns))


@query("position_accuracy", f"{JUDGED} SELECT CAST(i AS INTEGER) AS pos, count(*) AS n, round(avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM j GROUP BY i")
def position_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return metrics.position_accuracy(judged(spark, d), "labels", "preds").withColumn("accuracy", F.round("accuracy", 9))


@query("perplexity", "SELECT round(sum(l * n) / sum(n), 6) AS loss, round(exp(sum(l * n) / sum(n)), 6) AS perplexity FROM (SELECT l_discount * 20 AS l, l_quantity AS n FROM lineitem)")
def perplexity(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.perplexity(table(spark, d, "lineitem", "l_discount", "l_quantity"), F.col("l_discount") * 20, F.col("l_quantity"))
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query("weighted_loss", "SELECT l_returnflag AS split, round(sum(l_discount * l_quantity) / sum(l_quantity), 9) AS loss FROM lineitem GROUP BY l_returnflag")
def weighted_loss(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_returnflag", "l_discount", "l_quantity").withColumnRenamed("l_returnflag", "split")
    return metrics.perplexity(li, F.col("l_discount"), F.col("l_quantity"), by=["split"]).select("split", F.round("loss", 9).alias("loss"))


@query("accuracy_by_group", "SELECT toxic, count(*) FILTER (WHERE quality = p) AS correct, count(*) AS total, round(CAST(count(*) FILTER (WHERE quality = p) AS DOUBLE) / count(*), 9) AS accuracy FROM (SELECT toxic, quality, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS p FROM labels) GROUP BY toxic")
def accuracy_by_group(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").select("toxic", F.array("quality").alias("labels"), F.array(F.when(F.col("doc_id") % 3 == 0, 0).otherwise(1)).alias("preds"))
    return metrics.masked_accuracy(rows, by=["toxic"]).withColumn("accuracy", F.round("accuracy", 9))


@query("argmax_scores", "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS best FROM embeddings")
def argmax_scores(spark: SparkSession, d: str) -> DataFrame:
    from chainloom.functions.exprs import argmax

    return table(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", argmax(F.col("embedding")).alias("best"))


def _gram(n: int) -> str:
    return f"""g{n} AS (SELECT sum(least(c.n, coalesce(r.n, 0))) AS m FROM (SELECT item_id, g, count(*) AS n FROM (SELECT item_id, unnest(list_transform(range(1, greatest(len(c) - {n - 2}, 1)), lambda i: array_to_string(list_slice(c, i, i + {n - 1}), ' '))) AS g FROM w) GROUP BY ALL) c
LEFT JOIN (SELECT item_id, g, count(*) AS n FROM (SELECT item_id, unnest(list_transform(range(1, greatest(len(r) - {n - 2}, 1)), lambda i: array_to_string(list_slice(r, i, i + {n - 1}), ' '))) AS g FROM w) GROUP BY ALL) r USING (item_id, g)),
t{n} AS (SELECT sum(greatest(len(c) - {n - 1}, 0)) AS t FROM w)"""


BLEU_SQL = f"""WITH w AS (SELECT item_id, string_split(text, ' ') AS r, list_filter(string_split(text, ' '), lambda x, i: i % 7 <> 3 OR i < 5) AS c FROM benchmark),
{", ".join(_gram(n) for n in range(1, 5))}, l AS (SELECT sum(len(r)) AS r, sum(len(c)) AS c FROM w)
SELECT round(CASE WHEN l.c >= l.r THEN 1 ELSE exp(1 - CAST(l.r AS DOUBLE) / l.c) END * exp(({" + ".join(f"ln(CAST(g{n}.m AS DOUBLE) / t{n}.t)" for n in range(1, 5))}) / 4), 9) AS bleu FROM l, {", ".join(f"g{n}, t{n}" for n in range(1, 5))}"""


def texts(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark texts and variants of them that lack every seventh word."""
    words = F.split("text", " ")
    return table(spark, d, "benchmark").select("item_id", words.alias("r"), F.filter(words, lambda x, i: ((i + 1) % 7 != 3) | (i < 4)).alias("c"))


@query("bleu", BLEU_SQL)
def bleu(spark: SparkSession, d: str) -> DataFrame:
    return metrics.bleu(texts(spark, d), F.col("r"), F.col("c")).select(F.round("bleu", 9).alias("bleu"))


METEOR_SQL = """WITH w AS (SELECT item_id, string_split(text, ' ') AS r, list_filter(string_split(text, ' '), lambda x, i: i % 7 <> 3 OR i < 5) AS c FROM benchmark),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id, w ORDER BY i DESC) AS n FROM (SELECT item_id, unnest(r) AS w, generate_subscripts(r, 1) AS i FROM w)),
c AS (SELECT *, row_number() OVER (PARTITION BY item_id, w ORDER BY j DESC) AS n FROM (SELECT item_id, unnest(c) AS w, generate_subscripts(c, 1) AS j FROM w)),
m AS (SELECT item_id, i, j, lag(i) OVER p AS pi, lag(j) OVER p AS pj FROM r JOIN c USING (item_id, w, n) WINDOW p AS (PARTITION BY item_id ORDER BY j)),
k AS (SELECT item_id, count(*) AS m, count(*) FILTER (WHERE pi IS NULL OR i <> pi + 1 OR j <> pj + 1) AS chunks FROM m GROUP BY item_id)
SELECT item_id, round(coalesce((1 - 0.5 * pow(CAST(chunks AS DOUBLE) / m, 3)) * (CAST(m AS DOUBLE) / len(c)) * (CAST(m AS DOUBLE) / len(r)) / (0.9 * m / len(c) + 0.1 * m / len(r)), 0), 9) AS meteor FROM w LEFT JOIN k USING (item_id)"""


@query("meteor", METEOR_SQL)
def meteor(spark: SparkSession, d: str) -> DataFrame:
    return metrics.meteor(texts(spark, d), "item_id", "r", "c").select("item_id", F.round("meteor", 9).alias("meteor"))


ROUGE_SQL = """WITH RECURSIVE w AS (SELECT item_id, string_split(text, ' ') AS r, list_filter(string_split(text, ' '), lambda x, i: i % 7 <> 3 OR i < 5) AS c FROM benchmark),
s(item_id, r, c, i, line) AS (SELECT item_id, r, c, 0, list_transform(range(len(c) + 1), lambda x: 0) FROM w
UNION ALL SELECT item_id, r, c, i + 1, list_reduce(range(1, len(c) + 1), lambda acc, j: list_append(acc, CASE WHEN r[i + 1] = c[j] THEN line[j] + 1 ELSE greatest(line[j + 1], acc[j]) END), [0]) FROM s WHERE i < len(r))
SELECT item_id, round(CASE WHEN line[len(c) + 1] = 0 THEN 0 ELSE 2.0 * line[len(c) + 1] / (len(r) + len(c)) END, 9) AS rouge_l FROM s WHERE i = len(r)"""


@query("rouge_l", ROUGE_SQL)
def rouge_l(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("item_id", F.round(metrics.rouge_l()(F.col("r"), F.col("c")), 9).alias("rouge_l"))


@query(
    "meteor_exact",
    """WITH w AS (SELECT item_id, list_distinct(string_split(text, ' ')) AS r, list_distinct(list_filter(string_split(text, ' '), lambda x, i: i % 7 <> 3 OR i < 5)) AS c FROM benchmark),
m AS (SELECT item_id, CAST(len(list_intersect(r, c)) AS DOUBLE) AS b, len(r) AS r, len(c) AS c FROM w)
SELECT item_id, round(coalesce(10 * (b / c) * (b / r) / nullif(b / r + 9 * (b / c), 0), 0), 9) AS meteor FROM m""",
)
def meteor_exact(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("item_id", F.round(metrics.meteor_exact(F.col("r"), F.col("c")), 9).alias("meteor"))


@query(
    "early_stop",
    """WITH RECURSIVE s AS (SELECT CAST(date_trunc('day', ts) AS DATE) AS day, round(avg(value), 6) AS loss FROM events GROUP BY 1),
o AS (SELECT row_number() OVER (ORDER BY day) AS epoch, loss FROM s),
f AS (SELECT epoch, loss, loss AS best, 0 AS bad, FALSE AS stop FROM o WHERE epoch = 1
 UNION ALL SELECT o.epoch, o.loss, CASE WHEN o.loss < f.best - 0.5 THEN o.loss ELSE f.best END, CASE WHEN o.loss < f.best - 0.5 THEN 0 ELSE f.bad + 1 END, f.stop OR (CASE WHEN o.loss < f.best - 0.5 THEN 0 ELSE f.bad + 1 END) >= 3 FROM f JOIN o ON o.epoch = f.epoch + 1)
SELECT epoch, loss, best, bad, stop FROM f""",
)
def early_stop(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    days = table(spark, d, "events", "ts", "value").groupBy(F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("loss"))
    epochs = days.select(F.row_number().over(Window.orderBy("day")).cast("long").alias("epoch"), "loss")  # a row for each day
    return metrics.early_stop(epochs, "epoch", "loss", 3, 0.5)


@query("corpus_report", "SELECT lang AS split, source AS combo, count(*) AS n, CASE WHEN length(min(text)) > 50 THEN left(min(text), 50) || '...' ELSE min(text) END AS example FROM documents GROUP BY lang, source")
def corpus_report(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "lang", "source", "text").select(F.col("lang").alias("split"), F.array("source").alias("feats"), "text")
    return stats.report(docs, "text", "feats")


@query("row_count", "SELECT count(*) AS n, count(*) = 0 AS empty FROM lineitem")
def row_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) == 0).alias("empty"))


@query("token_flatten", f"WITH t AS ({IDS_SQL}) SELECT p_partkey, unnest(ids) AS token FROM t")
def token_flatten(spark: SparkSession, d: str) -> DataFrame:
    return ids(spark, d).select("p_partkey", F.explode("ids").alias("token"))


@query("bpe_train")
def bpe_train(spark: SparkSession, d: str) -> DataFrame:
    counts = tokens.word_counts(table(spark, d, "benchmark"), F.col("text"))
    merges = tokens.bpe_merges(counts, 50)
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(merges)], "rank int, first string, second string")


@query("bpe_encode")
def bpe_encode(spark: SparkSession, d: str) -> DataFrame:
    bench = table(spark, d, "benchmark")
    counts = tokens.word_counts(bench, F.col("text"))
    merges = tokens.bpe_merges(counts, 50)
    encoded = tokens.bpe_encoder(merges, tokens.bpe_vocabulary(counts, merges))
    return bench.select("item_id", text(encoded(F.col("text"))).alias("ids"))
