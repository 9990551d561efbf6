"""Evaluation metrics as global aggregates over (labels, predictions)."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainloom.operators.masking import IGNORED


def hits(labels: Column, preds: Column, counted) -> tuple[Column, Column]:  # noqa: ANN001
    """(correct, total) positions of a row whose label counts."""
    pairs = F.filter(F.arrays_zip(labels.alias("y"), preds.alias("p")), lambda r: counted(r["y"]))
    return F.size(F.filter(pairs, lambda r: r["y"] == r["p"])).cast("long"), F.size(pairs).cast("long")


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or there are no rows."""
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def masked_accuracy(df: DataFrame, labels: str = "labels", preds: str = "preds", by: list[str] | None = None) -> DataFrame:
    """correct, total and accuracy over all masked positions."""
    c, t = hits(F.col(labels), F.col(preds), lambda y: y != IGNORED)
    sums = df.select(*(by or []), c.alias("c"), t.alias("t")).groupBy(*(by or [])).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("correct"), F.coalesce(F.sum("t"), F.lit(0)).alias("total"))
    return sums.withColumn("accuracy", ratio(F.col("correct"), F.col("total")))


def example_accuracy(labels: Column, preds: Column) -> Column:
    """A row's masked accuracy, 1 if nothing is masked."""
    c, t = hits(labels, preds, lambda y: y != IGNORED)
    return F.when(t == 0, F.lit(1.0)).otherwise(c / t)


def token_accuracy(df: DataFrame, targets: str, preds: str, pad: int) -> DataFrame:
    """accuracy_with_pads counts padding on both sides of the fraction, accuracy doesn't."""
    all_c, all_t = hits(F.col(targets), F.col(preds), lambda y: F.lit(True))
    c, t = hits(F.col(targets), F.col(preds), lambda y: y != pad)
    sums = df.agg(F.sum(all_c).alias("a"), F.sum(all_t).alias("b"), F.sum(c).alias("c"), F.sum(t).alias("d"))
    return sums.select(ratio(F.col("a"), F.col("b")).alias("accuracy_with_pads"), ratio(F.col("c"), F.col("d")).alias("accuracy"))


def position_accuracy(df: DataFrame, targets: str, preds: str) -> DataFrame:
    """pos, n, accuracy at each position over all rows."""
    each = df.select(F.posexplode(F.arrays_zip(F.col(targets).alias("y"), F.col(preds).alias("p"))).alias("pos", "r"))
    return each.groupBy("pos").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("r.y") == F.col("r.p")).cast("double")).alias("accuracy"))


def perplexity(df: DataFrame, loss: Column, weight: Column, guard: float = 100.0, by: list[str] | None = None) -> DataFrame:
    """loss weighted by the number of tokens it is a mean of, and its exponential, infinite from guard on."""
    mean = F.try_divide(F.sum(loss * weight), F.sum(weight))
    return df.groupBy(*(by or [])).agg(mean.alias("loss")).withColumn("perplexity", F.when(F.col("loss") < guard, F.exp("loss")).otherwise(F.lit(float("inf"))))


def ngrams(words: Column, n: int) -> Column:
    count = F.size(words) - (n - 1)
    return F.when(count >= 1, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))).otherwise(F.expr("array()").cast("array<string>"))


def bleu(df: DataFrame, reference: Column, candidate: Column, order: int = 4) -> DataFrame:
    """Corpus BLEU: clipped n-gram matches and lengths are summed over all rows, then combined."""
    rows = df.select(reference.alias("r"), candidate.alias("c"))

    def clipped(n: int) -> tuple[Column, Column]:
        """Matches by sorted n-grams of both sides, each with its side: of equal ones, the lesser number."""
        r, c = ngrams(F.col("r"), n), ngrams(F.col("c"), n)
        tagged = lambda a, side: F.transform(a, lambda g: F.struct(g.alias("g"), F.lit(side).alias("s")))
        start = F.struct(F.lit(None).cast("string").alias("g"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("sum"))

        def step(acc: Column, x: Column) -> Column:
            same = acc["g"].eqNullSafe(x["g"])
            return F.struct(
                x["g"].alias("g"),
                (F.when(same, acc["a"]).otherwise(0) + (x["s"] == 0).cast("int")).alias("a"),
                (F.when(same, acc["b"]).otherwise(0) + (x["s"] == 1).cast("int")).alias("b"),
                (acc["sum"] + F.when(same, 0).otherwise(F.least(acc["a"], acc["b"]))).alias("sum"),
            )

        both = F.array_sort(F.concat(tagged(r, 0), tagged(c, 1)))
        return F.aggregate(both, start, step, lambda acc: acc["sum"] + F.least(acc["a"], acc["b"])), F.size(c)

    sums = []
    for n in range(1, order + 1):
        match, total = clipped(n)
        sums += [F.sum(match).alias(f"m{n}"), F.sum(total).alias(f"t{n}")]
    got = rows.agg(*sums, F.sum(F.size("r")).alias("r_len"), F.sum(F.size("c")).alias("c_len"))
    logs = reduce(lambda a, b: a + b, [F.log(F.try_divide(F.col(f"m{n}").cast("double"), F.col(f"t{n}"))) for n in range(1, order + 1)]) / order
    brevity = F.when(F.col("c_len") >= F.col("r_len"), F.lit(1.0)).otherwise(F.exp(1 - F.try_divide(F.col("r_len").cast("double"), F.col("c_len"))))
    return got.select(F.coalesce(brevity * F.exp(logs), F.lit(0.0)).alias("bleu"))


def common_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, by whole rows of bits."""
    place: dict = {}
    for i, x in enumerate(a):
        place[x] = place.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        match = row & place.get(y, 0)
        row = (row + match | row - match) & full
    return len(a) - row.bit_count()


def rouge_l() -> Column:
    """F-measure of the longest common subsequence of two word lists, as a vectorised function."""

    @F.pandas_udf("double")
    def score(references: pd.Series, candidates: pd.Series) -> pd.Series:
        return pd.Series([2 * common_length(list(a), list(b)) / max(1, len(a) + len(b)) for a, b in zip(references, candidates, strict=True)], dtype=float)

    return score


def meteor(df: DataFrame, key: str, reference: str, candidate: str) -> DataFrame:
    """key, meteor of exact words: the last occurrence of a word meets the other side's last, the one before it that side's
    one before. Recall counts nine times precision; half the cube of the share of chunks, runs in both texts' order, is the penalty.

    Stems and synonyms, which need word lists from elsewhere, aren't matched.
    """

    def places(words: str, place: str) -> DataFrame:
        each = df.select(key, F.posexplode(words).alias(place, "word"))
        return each.withColumn("nth", F.row_number().over(Window.partitionBy(key, "word").orderBy(F.desc(place))))

    order = Window.partitionBy(key).orderBy("j")
    met = places(reference, "i").join(places(candidate, "j"), [key, "word", "nth"])
    met = met.withColumn("starts", ~F.coalesce((F.col("i") == F.lag("i").over(order) + 1) & (F.col("j") == F.lag("j").over(order) + 1), F.lit(False)))
    counted = met.groupBy(key).agg(F.count(F.lit(1)).cast("double").alias("m"), F.sum(F.col("starts").cast("int")).alias("chunks"))
    p, r = F.col("m") / F.size(candidate), F.col("m") / F.size(reference)
    score = (1 - 0.5 * F.pow(F.col("chunks") / F.col("m"), 3)) * p * r / (0.9 * p + 0.1 * r)
    return df.select(key, reference, candidate).join(counted, key, "left").select(key, F.coalesce(score, F.lit(0.0)).alias("meteor"))


def meteor_exact(reference: Column, candidate: Column) -> Column:
    """The exact-match stage of METEOR without chunk penalty: recall counts nine times precision."""
    both = F.size(F.array_intersect(reference, candidate)).cast("double")
    p, r = F.try_divide(both, F.size(F.array_distinct(candidate))), F.try_divide(both, F.size(F.array_distinct(reference)))
    return F.coalesce(F.try_divide(10 * p * r, r + 9 * p), F.lit(0.0))


def early_stop(df: DataFrame, epoch: str, loss: str, patience: int, min_delta: float = 0.0, by: list[str] | None = None) -> DataFrame:
    """Each epoch's best loss so far, the epochs since it improved by min_delta, and whether training stops there.

    A fold over the ordered losses of a series; a series is as long as a training has epochs.
    """
    series = df.groupBy(*(by or [])).agg(F.array_sort(F.collect_list(F.struct(F.col(epoch).alias("epoch"), F.col(loss).alias("loss")))).alias("s"))
    start = F.struct(F.lit(None).cast("double").alias("best"), F.lit(0).alias("bad"), F.lit(False).alias("stop"), F.expr("array()").cast("array<struct<epoch:long,loss:double,best:double,bad:int,stop:boolean>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        better = acc["best"].isNull() | (x["loss"] < acc["best"] - F.lit(min_delta))
        best = F.when(better, x["loss"]).otherwise(acc["best"])
        bad = F.when(better, F.lit(0)).otherwise(acc["bad"] + 1)
        stop = acc["stop"] | (bad >= patience)
        row = F.struct(x["epoch"].cast("long").alias("epoch"), x["loss"].cast("double").alias("loss"), best.cast("double").alias("best"), bad.alias("bad"), stop.alias("stop"))
        return F.struct(best.cast("double").alias("best"), bad.alias("bad"), stop.alias("stop"), F.concat(acc["out"], F.array(row)).alias("out"))

    return series.select(*(by or []), F.inline(F.aggregate("s", start, step, lambda acc: acc["out"])))


def argmax_rows(df: DataFrame, key: str, place: str, score: str) -> DataFrame:
    """The place of each key's largest score, the first of equal ones."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), place))
    return df.withColumn("_n", first).filter("_n = 1").drop("_n")
