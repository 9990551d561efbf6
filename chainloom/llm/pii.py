"""Operator 5: information-theoretic sanitisation, with DataFrame expressions only.

Base spans are personal data by pattern: email, ip, card, phone. Their places come from the gaps and the hits that one
pattern leaves in a text, in code points. The method adds terms, words of LETTERS letters at least, that give protected
things away: the kinds, and each protected value, that is a kind's span with its text. All counts are of different texts,
over all documents, so copies count once. With D texts, n(e) of which hold e, n(t) the term t and n(t, e) the term within
CONTEXT characters of a span of e, the term discloses

    PMI(t; e) = log2(((n(t, e) - 1) / n(t)) / (n(e) / D))      of the information content      IC(e) = log2(D / n(e)).

The one that is taken off is the text at hand, which is no evidence for itself; so what stands beside a value in one text
only discloses nothing. At a share PMI / IC of GENERALISE or more a term is generalised, at REMOVE or more removed: a term
that gives a kind away next to spans of the kind, one that gives a value away throughout the texts that hold the value.

Defined results: a null text is empty and has no spans; a null doc_id stays null; each repeated row has a row of its
own; ties between kinds at one start go by kind as listed; an empty table gives no rows; other columns are ignored by
the query and returned by the stage, whatever their names; very long texts are searched whole.

The patterns are the plain ones with possessive quantifiers and a look at the character before, which find the same
leftmost matches in linear time: a match can only begin where its run of characters begins or where the last match ended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.llm.common import Workspace, documents

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "generalise", "remove")
CONTEXT = 80  # characters on either side of a base span
LETTERS = 3  # of a term at least
RUN = 256  # hits whose places are added up at a time
GENERALISE, REMOVE = 0.6, 0.9
BROADCAST_TERMS = 500_000

#: Pattern of each kind, and what a text has to hold for it to be worth a search. {13,} leaves out shorter runs of
#: digits, which a card's check of 14 to 19 digits would drop.
PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"[0-9](?:[ -]?[0-9]){13,}+", None),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "+"),
}

SPAN = "array<struct<start:int,rank:int,end:int,value:string>>"


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def summed(d: Column) -> Column:
    """Sum of a digit string's digits after every second one from the right has been doubled."""
    each = F.transform(
        F.split(F.reverse(d), ""),
        lambda x, i: F.when(x == "", F.lit(0)).when(i % 2 == 1, F.get(F.array(*[F.lit(n) for n in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), x.cast("int"))).otherwise(x.cast("int")),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        #: Parts may have any length: leading zeros go, and three digits compare as text.
        bare = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(value, r"\."), lambda p: (F.length(bare(p)) <= 3) & (F.lpad(bare(p), 3, "0") <= "255"))
    if kind == "card":
        d = digits(value)
        return F.length(d).between(14, 19) & (summed(d) % 10 == 0)
    if kind == "phone":
        return F.length(digits(value)).between(10, 15)
    return F.lit(True)


def placed(text: Column, pattern: Column | str) -> Column:
    """array<struct<start, end, value>> of a pattern's matches.

    Places are sums of the lengths of gaps and hits before; they are added up within runs of RUN hits, then over runs, as
    a growing array is copied with every element.
    """
    said = F.lit(pattern) if isinstance(pattern, str) else pattern
    gaps, hits = F.split(text, said, -1), F.regexp_extract_all(text, said, F.lit(0))
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(F.length(g).alias("gap"), h.alias("hit")))
    hit = "array<struct<start:int,end:int,value:string>>"

    def inside(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("value")))).alias("out"))

    def run(part: Column) -> Column:
        return F.aggregate(part, F.struct(F.lit(0).alias("at"), F.expr("array()").cast(hit).alias("out")), inside)

    def over(acc: Column, r: Column) -> Column:
        moved = F.transform(r["out"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"), s["value"].alias("value")))
        return F.struct((acc["at"] + r["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    def all_runs(pairs: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / RUN).cast("int")), lambda k: run(F.slice(pairs, k * RUN + 1, F.lit(RUN))))
        return F.flatten(F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.expr("array()").cast(f"array<{hit}>").alias("out")), over, lambda acc: acc["out"]))

    #: A function's argument is evaluated once.
    return F.flatten(F.transform(F.filter(F.array(pairs), lambda p: F.size(p) > 0), all_runs))


def spans_of(kind: str, text: Column) -> Column:
    """Matches of one kind that pass its check."""
    pattern, needs = PATTERNS[kind]
    found = F.transform(placed(text, pattern), lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"), s["value"].alias("value")))
    worth = text.contains(needs) if needs else F.lit(True)
    worth = worth & text.rlike("[0-9]") if kind != "email" else worth
    return F.when(worth & text.rlike(pattern.replace(r"\G|", "")), F.filter(found, lambda s: passes(kind, s["value"]))).otherwise(F.expr("array()").cast(SPAN))


def base_spans(text: Column) -> Column:
    """All base spans by start, then kind as listed."""
    return F.array_sort(F.concat(*(spans_of(k, text) for k in KINDS)))


def context_terms(text: Column, spans: Column) -> Column:
    """array<struct<term, rank, value, start, end>>: words next to base spans and outside all of them."""
    empty = "array<struct<term:string,rank:int,value:string,start:int,end:int>>"

    def side(s: Column, begin: Column, stop: Column, cut_first: bool) -> Column:
        """Letter runs of text[begin:stop); the run that the window cuts is left out."""
        part = F.substring(text, begin + 1, F.greatest(stop - begin, F.lit(0)))
        part = F.concat(part, F.lit(" ")) if cut_first else part
        gaps, words = F.split(part, r"\p{L}+", -1), F.regexp_extract_all(part, F.lit(r"\p{L}+"), F.lit(0))
        pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(words)), words, lambda g, w: F.struct(g.alias("g"), w.alias("w")))
        step = lambda acc, x: F.struct(
            (acc["at"] + F.length(x["g"]) + F.length(x["w"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct(F.lower(x["w"]).alias("term"), s["rank"].alias("rank"), s["value"].alias("value"), (acc["at"] + F.length(x["g"])).alias("start"), (acc["at"] + F.length(x["g"]) + F.length(x["w"])).alias("end")))).alias("out"),
        )
        found = F.aggregate(pairs, F.struct(begin.alias("at"), F.expr("array()").cast(empty).alias("out")), step, lambda acc: acc["out"])
        if cut_first:
            return F.filter(found, lambda w: (w["start"] > begin) | (begin == 0))
        return F.filter(found, lambda w: (w["end"] < stop) | (stop == F.length(text)))

    near = F.flatten(
        F.transform(
            spans,
            lambda s: F.concat(
                side(s, F.greatest(s["start"] - CONTEXT, F.lit(0)), s["start"], True),
                side(s, s["end"], F.least(s["end"] + CONTEXT, F.length(text)), False),
            ),
        )
    )
    return F.array_distinct(F.filter(near, lambda w: (w["end"] - w["start"] >= LETTERS) & ~F.exists(spans, lambda s: (s["start"] < w["end"]) & (s["end"] > w["start"]))))


def sized(spark_df: DataFrame, most: int) -> DataFrame:
    """Broadcast up to so many rows, counted; a shuffle join beyond."""
    return F.broadcast(spark_df) if spark_df.count() <= most else spark_df


def shares(pairs: DataFrame, held: DataFrame, seen: DataFrame, of: list[str], texts: int) -> DataFrame:
    """term, of, action of the terms that give something away.

    pairs: term, of, n_near; held: of, n_held; seen: term, n. All are numbers of different texts.
    """
    rated = pairs.join(seen, "term").join(held, of)
    content = F.log2(F.lit(float(texts)) / F.col("n_held"))
    share = F.log2((F.col("n_near") - 1) / F.col("n") * F.lit(float(texts)) / F.col("n_held")) / F.nullif(content, F.lit(0.0))
    action = F.when(share >= REMOVE, F.lit(ALL_KINDS.index("remove"))).otherwise(F.lit(ALL_KINDS.index("generalise")))
    return rated.filter(share >= GENERALISE).select("term", *of, action.alias("action"))


def disclosing(texts: DataFrame, rows: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """Terms that give kinds away (term, rank, action) and values (term, rank, value, action).

    texts: th (the text's hash), text of all documents; rows: th, base, near of those with base spans.
    """
    copies = work.table(texts.groupBy("th").agg(F.count(F.lit(1)).alias("copies")), "copies")
    different = copies.count()
    near = rows.select("th", F.inline("near")).select("th", "term", "rank", "value").distinct()
    near = work.table(near, "near")
    pairs = {}
    for name, of in (("kinds", ["rank"]), ("values", ["rank", "value"])):
        each = near if name == "values" else near.select("th", "term", "rank").distinct()
        pairs[name] = each.groupBy("term", *of).agg(F.count(F.lit(1)).alias("n_near")).filter("n_near > 1")
    candidates = work.table(pairs["kinds"].select("term").distinct(), "candidates")  # what is next to a value twice is so to its kind
    words = F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("term")
    weighed = texts.join(sized(copies.filter("copies > 1"), BROADCAST_TERMS), "th", "left").select((1 / F.coalesce("copies", F.lit(1))).alias("weight"), words)
    seen = weighed.join(sized(candidates, BROADCAST_TERMS), "term").groupBy("term").agg(F.round(F.sum("weight"), 3).alias("n"))
    seen = work.table(seen, "seen")
    spans = rows.select("th", F.inline("base")).select("th", "rank", "value").distinct()
    out = []
    for name, of in (("kinds", ["rank"]), ("values", ["rank", "value"])):
        held = spans.select("th", *of).distinct().groupBy(*of).agg(F.count(F.lit(1)).alias("n_held"))
        out.append(work.table(shares(pairs[name], held, seen, of, different), name))
    return out[0], out[1]


TERMS = "array<struct<start:int,rank:int,end:int>>"


def find_terms(texts: DataFrame, rows: DataFrame, work: Workspace) -> DataFrame:
    """uid, terms array<struct<start, rank, end>> of the documents that have disclosing terms.

    texts: th, text of all documents; rows: uid, th, text, base, near of those with base spans, already written.
    """
    kinds, values = disclosing(texts, rows, work)
    beside = rows.select("uid", F.inline("near")).join(sized(kinds, BROADCAST_TERMS), ["term", "rank"])
    beside = beside.select("uid", "start", F.col("action").alias("rank"), "end")
    #: Terms of the values that a text holds are looked for in the whole of it.
    holds = rows.select("uid", F.inline("base")).select("uid", "rank", "value").distinct().join(sized(values, BROADCAST_TERMS), ["rank", "value"])
    wanted = holds.groupBy("uid", "term").agg(F.max("action").alias("action")).groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("term", "action"))).alias("wanted"))
    listed = F.array_join(F.transform("wanted", lambda w: w["term"]), "|")
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), listed, F.lit(r")(?!\p{L})"))
    hits = rows.join(wanted, "uid").select("uid", "base", F.map_from_entries("wanted").alias("action"), placed(F.col("text"), pattern).alias("hits"))
    apart = F.filter("hits", lambda h: ~F.exists("base", lambda s: (s["start"] < h["end"]) & (s["end"] > h["start"])))
    whole = hits.select("uid", "action", F.inline(apart)).select("uid", "start", F.try_element_at("action", F.lower("value")).alias("rank"), "end").filter("rank IS NOT NULL")
    each = beside.unionByName(whole).groupBy("uid", "start", "end").agg(F.max("rank").alias("rank"))
    return each.groupBy("uid").agg(F.collect_set(F.struct("start", "rank", "end")).alias("terms"))


def joined(spans: Column) -> Column:
    """kind:start:end of sorted spans, with commas between."""
    names = F.array(*[F.lit(k) for k in ALL_KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pii")
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = docs.withColumn("base", base_spans(F.col("text"))).withColumn("near", context_terms(F.col("text"), F.col("base")))
    some = F.size("base") > 0
    rows = rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "base", "near", F.when(some, text_hash(F.col("text"))).alias("th"), F.when(some, F.col("text")).alias("text"))
    rows = work.table(rows, "spans")
    terms = find_terms(docs.select(text_hash(F.col("text")).alias("th"), "text"), rows.filter(F.size("base") > 0), work)
    bare = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    added = F.coalesce(F.col("terms"), F.expr("array()").cast(TERMS))
    n = lambda k: F.size(F.filter("base", lambda s: s["rank"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return rows.join(terms, "uid", "left").select(
        "doc_id",
        *(n(k) for k in KINDS),
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat(bare, added))).alias("spans"),
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """Documents with their base spans generalised to their kind and disclosing terms generalised or removed.

    Texts without base spans pass unchanged and don't move; the others are written once with their spans.
    """
    work, columns = Workspace(docs.sparkSession, "sanitise"), docs.columns
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    none = docs.filter(F.size(base_spans(text)) == 0)
    held = docs.select(F.struct("*").alias("row"), base_spans(text).alias("base"), text.alias("whole")).filter(F.size("base") > 0)
    held = held.select(F.monotonically_increasing_id().alias("uid"), "row", "base", context_terms(F.col("whole"), F.col("base")).alias("near"), text_hash(F.col("whole")).alias("th"))
    held = work.table(held, "held")
    rows = held.select("uid", "th", F.coalesce(F.col("row.text").cast("string"), F.lit("")).alias("text"), "base", "near")
    terms = find_terms(docs.select(text_hash(text).alias("th"), text.alias("text")), rows, work)
    bare = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    added = F.coalesce(F.col("terms"), F.expr("array()").cast(TERMS))
    names = F.array(*[F.lit("") if k == "remove" else F.lit("[TERM]") if k == "generalise" else F.lit(f"[{k.upper()}]") for k in ALL_KINDS])
    whole = F.col("row.text")
    step = lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.array(F.substring(whole, acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["rank"])))).alias("out"),
    )
    last = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(whole, acc["at"] + 1, F.length(whole)))
    clean = F.aggregate(F.array_sort(F.concat(bare, added)), F.struct(F.lit(0).alias("at"), F.expr("array()").cast("array<string>").alias("out")), step, last)
    put = held.join(terms, "uid", "left").select(*(clean.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in columns))
    return none.unionByName(put)
