"""Operator 2: language identification by averaged hashed subword embeddings and a linear softmax.

Subwords are the byte 2-, 3- and 4-grams of the lower-cased text, every run of ASCII characters other than letters being
one blank; each is hashed to one of BUCKETS rows of an embedding table. A text is the average of its subwords' embeddings,
then a linear softmax. Both start from stochastic gradient descent in numpy, on labelled rows of each language chosen by a
hash of id and text: SAMPLE texts at most, or one of each language if there are more, PER_LANGUAGE of each language. If
these aren't all, embedding and softmax, folded into one table of BUCKETS by languages, descend in PASSES steps over every
labelled row but a tenth, with sums made on the executors. A text's shares add up to 1, so the loss bends in no direction
more than half the mean shares of the buckets; a step of twice the gradient by those can't raise the loss of all rows,
however they are dealt out, and takes a rare subword as far as a frequent one. Equal rows count as one.

The other tenth, by a hash, of each language with LEAST_JUDGED rows calibrates a temperature for the probabilities. Two
limits reject a text: of its probability, and of the mean log share of its subwords among those of its language, in all
rows learned from; that tells texts of languages that weren't learned, of which the softmax can be sure, and works with one
language as well. Both are quantiles of the whole tenth: at most one in REJECTED of its texts falls below either. Where
fewer than 2 * REJECTED texts calibrate, which have no such quantile, it is that of an exponential tail from their median to
the least value, and that of n texts' probability at most 1 - 1 / sqrt(n); fewer than LEAST_JUDGED texts calibrate no
limit, and nothing with a letter is rejected.

Counting subwords of whole texts is done on the executors, both for training and prediction; a very long text is counted
piece by piece, cut at blanks. Prediction folds embedding and softmax into one table of BUCKETS by languages.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and is rejected; without any labelled
text, as in an empty table, everything is ``und``; null lang is never learned from; a null doc_id is an id; of languages
with the same probability the first by name is predicted; repeated rows each give a row and train as one; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import fsum
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.llm.common import Workspace, bound_batches, documents, fold_of

BUCKETS = 1 << 13
WIDTH = 16
PER_LANGUAGE = 600
SAMPLE = 3000
EPOCHS = 20  # at least
STEPS = 800  # of descent at least: small samples are gone through more often
BATCH = 64
RATE = 0.5
REJECTED = 500  # at most one in so many calibration texts is rejected
PASSES = 3  # over all rows that train, where the sample isn't all of them
SUMMED = 8  # tasks that add up the sums of a pass
LEAST_JUDGED = 50
RARE = 1e-6  # share of a subword that a language's sample doesn't have
PIECE = 1 << 18  # characters of a text whose subwords are counted at a time, and on to the next blank
UND = "und"
TEMPERATURES = np.geomspace(0.25, 8, 41)

#: Non-letters of ASCII become blanks; bytes of other characters stay.
BLANKED = bytes(x if chr(x).isalpha() or x > 127 else 32 for x in range(256))
PREDICTED = "lang_pred string, score double, accepted boolean"


class Model(NamedTuple):
    languages: list[str]
    table: np.ndarray  # (BUCKETS, languages): embedding times softmax weights
    bias: np.ndarray
    temperature: float
    rejecting: float
    typical: np.ndarray  # (BUCKETS, languages): log of each bucket's share in the language
    atypical: float  # a text whose mean is below it is rejected


def grams(part: bytes) -> Iterator[np.ndarray]:
    """Bucket of each 2-, 3- and 4-gram of a padded piece."""
    x = np.frombuffer(part, np.uint8).astype(np.uint32)
    h = x
    for n in (2, 3, 4):
        if len(x) < n:
            return
        h = h[: len(x) - n + 1] * np.uint32(0x01000193) ^ x[n - 1 :]
        yield ((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13)).astype(np.intp)


def counts(text: str | None) -> np.ndarray | None:
    """Number of subwords in each bucket; None without a letter."""
    if not text or not any(map(str.isalpha, text)):
        return None
    total, at = np.zeros(BUCKETS, np.int64), 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end] > " ":
            end += 1
        words = b" ".join(text[at:end].lower().encode().translate(BLANKED).split())
        for g in grams(b" " + words + b" "):
            total += np.bincount(g, minlength=BUCKETS)
        at = end
    return total


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Shares(NamedTuple):
    """Sparse rows of features: a text's buckets and their shares. Only the rows of a batch are ever dense."""

    buckets: list[np.ndarray]
    shares: list[np.ndarray]

    def dense(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), BUCKETS), np.float32)
        for i, r in enumerate(rows):
            out[i, self.buckets[r]] = self.shares[r]
        return out

    def __len__(self) -> int:
        return len(self.buckets)


def lowest(values: np.ndarray) -> float:
    """The limit below which at most one in 2 * REJECTED of the values lies; where there are fewer, of an exponential tail."""
    values, n = np.sort(values), len(values)
    if n >= 2 * REJECTED:  # half of the rejected by either limit
        return float(values[n // (2 * REJECTED)]) - 1e-6
    middle = float(np.median(values))
    return middle - (middle - float(values[0])) * float(np.log(REJECTED) / np.log(n / 2)) - 1e-6


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-12, 1 - 1e-12)
    return np.log(p / (1 - p))


def limited(model: Model, judged: np.ndarray) -> Model:
    """The model with limits from probabilities and mean log shares of calibration texts."""
    n = len(judged)
    if n < LEAST_JUDGED:
        return model
    odds = lowest(log_odds(judged[:, 0]))
    if n < 2 * REJECTED:  # so few texts tell no finer difference from certainty
        odds = min(odds, float(log_odds(1 - 1 / np.sqrt(n + 2))))
    return model._replace(rejecting=1 / (1 + float(np.exp(-odds))), atypical=lowest(judged[:, 1]))


def losses(raw: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """Sum of the negative log probabilities of the true languages at each of TEMPERATURES."""
    return np.array([-np.log(softmax(raw / t)[np.arange(len(truth)), truth] + 1e-12).sum() for t in TEMPERATURES])


def log_shares(total: np.ndarray) -> np.ndarray:
    """Log of each bucket's share in a language, from sums of texts' shares."""
    typical = RARE + total / np.maximum(total.sum(axis=0), 1)
    return np.log(typical / typical.sum(axis=0)).astype(np.float32)


def train(features: Shares, labels: np.ndarray, languages: list[str]) -> tuple[Model, np.ndarray]:
    """The model, without limits, and what it says of the rows that calibrate, every tenth one.

    features: subword shares of each text, in a fixed order.
    """
    rng = np.random.default_rng(7)
    held = np.arange(len(labels)) % 10 == 9
    if held.sum() < len(languages) or len(labels) < 50:
        held[:] = False
    own, y = np.flatnonzero(~held), labels[~held]
    embed = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    weight, bias = np.zeros((WIDTH, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    scale = np.float32(np.sqrt(BUCKETS) / 8)  # averages of thousands of buckets are small
    epochs = max(EPOCHS, -(-STEPS * BATCH // len(y)))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            x = features.dense(own[rows])
            mean = scale * (x @ embed)
            off = softmax(mean @ weight + bias)
            off[np.arange(len(rows)), y[rows]] -= 1
            off /= len(rows)
            back = off @ weight.T
            weight -= rate * (mean.T @ off)
            bias -= rate * off.sum(axis=0)
            embed -= rate * scale * (x.T @ back)
    table = scale * (embed @ weight)
    judges = np.flatnonzero(held) if held.any() else own
    truth = labels[judges]
    raw = np.concatenate([features.dense(judges[at : at + BATCH]) @ table for at in range(0, len(judges), BATCH)]) + bias
    temperature = float(TEMPERATURES[losses(raw, truth).argmin()])
    total = np.zeros((BUCKETS, len(languages)))
    for i in own:
        total[features.buckets[i], labels[i]] += features.shares[i]
    model = Model(languages, table.astype(np.float32), bias, temperature, 0.0, log_shares(total), -np.inf)
    return model, np.array([judge(model, features.buckets[i], features.shares[i])[1:] for i in judges])


def judge(model: Model, buckets: np.ndarray, shares: np.ndarray) -> tuple[int, float, float]:
    """The likeliest language, its probability, and the mean log share of the text's subwords in it."""
    p = softmax(((shares @ model.table[buckets]) + model.bias)[None] / model.temperature)[0]
    best = int(p.argmax())
    return best, float(p[best]), float(shares @ model.typical[buckets, best])


class Labelled(NamedTuple):
    """Rows that may train, each with a place from 0 to 1 by its id and text, and the places of the sample by language."""

    rows: DataFrame  # lang, key, place, text
    each: int  # texts of a language in the sample
    until: dict[str, float]  # places below it are the sample's
    sizes: dict[str, int]  # different rows of each language
    repeated: bool  # whether there are equal rows

    def whole(self) -> bool:
        """Whether the sample is all rows."""
        return max(self.sizes.values(), default=0) <= self.each

    def calibrates(self) -> Column:
        """A tenth of the rows, by a hash, where a language has enough."""
        return (F.pmod(F.xxhash64("key"), F.lit(10)) == 9) & ~F.col("lang").isin([k for k, n in self.sizes.items() if n < LEAST_JUDGED])


def labelled(docs: DataFrame, trains: Column) -> Labelled:
    rows = docs.filter(trains & F.col("lang").isNotNull() & F.col("text").cast("string").rlike(r"\p{L}"))
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.select(F.col("lang").cast("string").alias("lang"), key.alias("key"), (F.pmod(key, F.lit(1 << 40)) / F.lit(1 << 40)).alias("place"), F.col("text").cast("string").alias("text"))
    got = rows.groupBy("lang", "key").count().groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.max("count").alias("most")).collect()
    sizes = {r["lang"]: r["n"] for r in sorted(got)}
    each = min(PER_LANGUAGE, max(1, SAMPLE // max(1, len(sizes))))
    return Labelled(rows, each, {k: min(1.0, (1.2 * each + 20) / n) for k, n in sizes.items()}, sizes, any(r["most"] > 1 for r in got))


def chosen(known: Labelled, beyond: bool = False) -> DataFrame:
    """Rows of the sample, a little more than its bound; or the rows beyond it."""
    spark = known.rows.sparkSession
    limits = spark.createDataFrame(list(known.until.items()), "lang string, until double")  # a row for each language
    rows = known.rows.join(F.broadcast(limits), "lang")
    inside = F.col("place") < F.col("until")
    return rows.filter(~inside if beyond else inside).select("lang", "place", "text")


def once(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, float, np.ndarray]]]:
    """Language, place and subword counts of each batch's texts with letters; equal rows of a task only once."""
    seen: set[tuple[str, float]] = set()
    for batch in batches:
        out = []
        for lang, at, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if (lang, at) not in seen:
                seen.add((lang, at))
                if (c := counts(text.as_py())) is not None:
                    out.append((lang, at, c))
        if out:
            yield out


def sample(known: Labelled) -> tuple[Shares, np.ndarray, list[str]]:
    """Features, labels and languages of the bounded sample. Only its features travel."""

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in once(batches):
            full = [np.flatnonzero(c) for _, _, c in rows]
            columns = [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])]
            columns += [pa.array([f.astype("<u2").tobytes() for f in full]), pa.array([(r[2][f] / r[2].sum()).astype("<f4").tobytes() for r, f in zip(rows, full, strict=True)])]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "place", "bucket", "share"])

    got = chosen(known).mapInArrow(featured, "lang string, place double, bucket binary, share binary").dropDuplicates(["lang", "place"])
    got = sorted(got.toArrow().to_pylist(), key=lambda r: (r["place"], r["lang"]))
    taken: dict[str, int] = {}
    kept = []
    for r in got:
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= known.each:
            kept.append(r)
    languages = sorted(taken)
    x = Shares([np.frombuffer(r["bucket"], "<u2") for r in kept], [np.frombuffer(r["share"], "<f4") for r in kept])
    return x, np.array([languages.index(r["lang"]) for r in kept], np.int64), languages


def added(sums: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """Sum of the arrays of all tasks, in a fixed order: in SUMMED tasks, then on the driver."""

    def adding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, total = None, np.zeros(shape)
        for batch in batches:
            for task, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                first = task if first is None else first
                total += np.frombuffer(blob.as_buffer(), np.float64).reshape(shape)
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([total.tobytes()])], names=["task", "sums"])

    got = sums.repartition(SUMMED).sortWithinPartitions("task").mapInArrow(adding, "task int, sums binary").toArrow().sort_by("task")
    return reduce(np.add, (np.frombuffer(x.as_buffer(), np.float64).reshape(shape) for x in got["sums"]), np.zeros(shape))


def slope(model: Model, rows: DataFrame) -> np.ndarray:
    """Two tables of BUCKETS by languages over all rows (lang, weight, text): the loss's gradient, and texts' shares by language."""
    shape, place = (2, BUCKETS, len(model.languages)), {x: i for i, x in enumerate(model.languages)}

    def summing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for lang, weight, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if lang in place and (c := counts(text.as_py())) is not None:
                    full = np.flatnonzero(c)
                    share = c[full] / c.sum()
                    off = softmax((share @ model.table[full] + model.bias)[None])[0]
                    off[place[lang]] -= 1
                    total[0, full] += np.outer(weight * share, off)
                    total[1, full, place[lang]] += weight * share
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()])], names=["task", "sums"])

    return added(rows.mapInArrow(summing, "task int, sums binary"), shape)


def descended(model: Model, known: Labelled, work: Workspace) -> Model:
    """The model after PASSES steps over all rows, with the shares of subwords in all of them."""
    rows = known.rows.withColumn("weight", F.lit(1.0))
    if known.repeated:
        times = work.table(known.rows.groupBy("lang", "key").count().filter("count > 1"), "repeated")
        rows = known.rows.join(times, ["lang", "key"], "left").withColumn("weight", 1 / F.coalesce("count", F.lit(1)))
    for _ in range(PASSES):
        gradient, shares = slope(model, rows.select("lang", "weight", "text"))
        step = 2 * gradient / np.maximum(shares.sum(axis=1, keepdims=True), 1e-12)
        model = model._replace(table=(model.table - step).astype(np.float32))
    return model._replace(typical=log_shares(shares))


def calibrated(model: Model, rows: DataFrame, work: Workspace) -> Model:
    """The model with temperature and limits from all of the rows, which it hasn't learned from."""
    place = {x: i for i, x in enumerate(model.languages)}

    def judging(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if lang in place and (c := counts(text.as_py())) is not None:
                    full = np.flatnonzero(c)
                    share = c[full] / c.sum()
                    out.append((place[lang], key, share @ model.table[full] + model.bias, judge(model, full, share)[2]))
            if out:
                columns = [pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out]), pa.array([r[2].tolist() for r in out]), pa.array([r[3] for r in out])]
                yield pa.RecordBatch.from_arrays(columns, names=["truth", "key", "raw", "typical"])

    def losing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = losses(np.array(batch.column(1).to_pylist()), batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([x.tolist()]), pa.array([len(batch.column(0))])], names=["losses", "n"])

    said = rows.select("lang", "key", "text").mapInArrow(judging, "truth int, key long, raw array<double>, typical double")
    said = work.table(said.dropDuplicates(["truth", "key"]), "judged")
    lost = said.select("truth", "raw").mapInArrow(losing, "losses array<double>, n long").collect()
    n = sum(r["n"] for r in lost)
    if n < LEAST_JUDGED:
        return model
    model = model._replace(temperature=float(TEMPERATURES[np.argmin([fsum(x) for x in zip(*(r["losses"] for r in lost), strict=True)])]))
    most, t = F.array_max("raw"), F.lit(model.temperature)
    p = 1 / F.aggregate("raw", F.lit(0.0), lambda total, x: total + F.exp((x - most) / t))
    values = said.select(p.alias("p"), "typical")
    if n < 2 * REJECTED:
        return limited(model, np.array([tuple(r) for r in values.collect()]))
    at = n // (2 * REJECTED)  # half of the rejected by either limit
    p, typical = (values.orderBy(c).limit(at + 1).agg(F.max(c)).first()[0] for c in values.columns)
    return model._replace(rejecting=1 / (1 + float(np.exp(1e-6 - log_odds(p)))), atypical=typical - 1e-6)


def fit(docs: DataFrame, trains: Column) -> Model | None:
    """A model of the labelled rows for which trains holds; None if there are none with letters."""
    bound_batches(docs.sparkSession)
    known = labelled(docs, trains)
    learn = known if known.whole() else known._replace(rows=known.rows.filter(~known.calibrates()))
    x, y, languages = sample(learn)
    if not len(y):
        return None
    model, own = train(x, y, languages)
    if known.whole():
        return limited(model, own)
    work = Workspace(docs.sparkSession, "language-id")
    return calibrated(descended(model, learn, work), known.rows.filter(known.calibrates()), work)


def predicted(model: Model | None, text: Column) -> Column:
    """Struct column lang_pred, score, accepted of whole texts."""

    @F.arrow_udf(PREDICTED)
    def predict(texts: pa.Array) -> pa.Array:
        lang, score, accepted = [], [], []
        for text in texts:
            c = counts(text.as_py()) if model is not None else None
            if c is None:
                lang.append(UND), score.append(0.0), accepted.append(False)
                continue
            full = np.flatnonzero(c)
            best, sure, typical = judge(model, full, c[full] / c.sum())
            lang.append(model.languages[best]), score.append(sure), accepted.append(sure >= model.rejecting and typical >= model.atypical)
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())], names=["lang_pred", "score", "accepted"])

    return predict(text)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(fold_of(F.col("doc_id"), 4) == 2, F.lit(False))
    model = fit(docs, ~held_out)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), predicted(model, F.col("text").cast("string")).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score", "p.accepted")
