"""Token arrays: vocabularies, encoding, windows, padding."""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAD, UNK = "[PAD]", "[UNK]"

#: Special tokens in the order of their ids.
SPECIALS = [PAD, UNK, "[END]", "[TRA]", "[ETRA]", "[TRB]", "[ETRB]", "[PEP]", "[EPEP]", "[MHO]", "[EMHO]", "[MHT]", "[EMHT]"]
MOST_WORDS = 1_000_000  # different words that merges are learned from in the driver; beyond, in Spark


def word_counts(df: DataFrame, text: Column) -> DataFrame:
    """word, n over blank-separated words."""
    words = df.select(F.explode(F.split(text, " ")).alias("word")).filter("word <> ''")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(df: DataFrame, text: Column, size: int, specials: list[str] | None = None) -> dict[str, int]:
    """Ids: specials first, then the most frequent words, ties in code-point order. A report of at most size rows."""
    specials = SPECIALS if specials is None else specials
    top = word_counts(df, text).filter(~F.col("word").isin(specials)).orderBy(F.desc("n"), "word").limit(size - len(specials))
    return {w: i for i, w in enumerate([*specials, *(r["word"] for r in top.collect())])}


def vocabulary_map(vocab: dict[str, int]) -> Column:
    return F.map_from_arrays(F.array(*(F.lit(w) for w in vocab)), F.array(*(F.lit(i) for i in vocab.values())))


def encode(text: Column, vocab: Column, unk: int) -> Column:
    """Ids of blank-separated words; unknown words get unk."""
    return F.transform(F.filter(F.split(text, " "), lambda w: w != ""), lambda w: F.coalesce(F.try_element_at(vocab, w), F.lit(unk)))


def inverted(vocab: Column) -> Column:
    """id to word."""
    return F.map_from_entries(F.transform(F.map_entries(vocab), lambda e: F.struct(e["value"], e["key"])))


def decode(ids: Column, words: Column) -> Column:
    return F.array_join(F.transform(ids, lambda i: F.coalesce(F.try_element_at(words, i), F.lit(UNK))), " ")


def padded(ids: Column, length: int, pad: int = 0) -> Column:
    """Exactly length ids: cut, or filled up at the end."""
    return F.concat(F.slice(ids, 1, length), F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - F.size(ids), F.lit(0))))


def shifted(ids: Column, length: int, pad: int = 0, truncate: bool = True) -> tuple[Column, Column]:
    """(x, y): ids without the last and without the first, of the given length each.

    With truncate, ids are cut or filled to length before the shift, and the pair is filled up afterwards; without, long
    ids are shifted first and cut afterwards, so that x is ids[0:L] and y is ids[1:L+1].
    """
    fixed = padded(ids, length, pad)
    fixed = fixed if truncate else F.when(F.size(ids) > length, ids).otherwise(fixed)
    return padded(F.slice(fixed, F.lit(1), F.size(fixed) - 1), length, pad), padded(F.slice(fixed, F.lit(2), F.greatest(F.size(fixed) - 1, F.lit(0))), length, pad)


def windows(ids: Column, length: int, step: int = 1, pad: int = 0) -> Column:
    """array<struct<x, y>> of windows of length + 1 ids every step; short ids give one filled-up window."""
    n = F.floor((F.size(ids) - F.lit(length + 1)) / F.lit(step)).cast("int") + 1
    many = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.slice(ids, i * step + 1, F.lit(length + 1)))
    full = F.when(n >= 1, many).otherwise(F.array(padded(ids, length + 1, pad)))
    return F.transform(full, lambda w: F.struct(F.slice(w, 1, length).alias("x"), F.slice(w, 2, length).alias("y")))


def attention_mask(ids: Column, pad: int = 0) -> Column:
    return F.transform(ids, lambda t: (t != pad).cast("int"))


def batch_padded(df: DataFrame, batch: str, ids: str = "input_ids", pad: int = 0) -> DataFrame:
    """Fills ids up to the longest of their batch and adds attention_mask."""
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    out = df.withColumn("_longest", longest).withColumn("attention_mask", F.concat(F.transform(ids, lambda t: F.lit(1)), F.array_repeat(F.lit(0), F.col("_longest") - F.size(ids))))
    return out.withColumn(ids, F.concat(ids, F.array_repeat(F.lit(pad), F.col("_longest") - F.size(ids)))).drop("_longest")


def bpe_merges(counts: DataFrame, merges: int, most_words: int = MOST_WORDS) -> list[tuple[str, str]]:
    """The most frequent neighbours, one after the other, learned from a table of words and counts.

    Counting the corpus is Spark's; merging works on different words only, with pair counts kept up to date for the words
    that hold a pair. If there are more than most_words, Spark sums the pairs of all words anew for each merge. Ties go to
    the least pair.
    """
    counted = counts.filter(~F.col("word").isin(SPECIALS)).select("word", "n")
    rows = counted.limit(most_words + 1).collect()
    if len(rows) > most_words:
        return bpe_merges_spread(counted, merges)
    words = [list(r["word"]) for r in rows]
    n = [r["n"] for r in rows]
    pairs: Counter = Counter()
    where: dict[tuple[str, str], set[int]] = defaultdict(set)
    for k, w in enumerate(words):
        for p in zip(w, w[1:], strict=False):
            pairs[p] += n[k]
            where[p].add(k)
    heap = [(-c, p) for p, c in pairs.items()]
    heapq.heapify(heap)
    out: list[tuple[str, str]] = []
    while heap and len(out) < merges:
        c, p = heapq.heappop(heap)
        if pairs[p] != -c or not c:
            continue  # counted anew since
        out.append(p)
        touched = set()
        for k in list(where.pop(p)):
            old = words[k]
            for q in zip(old, old[1:], strict=False):
                pairs[q] -= n[k]
                where[q].discard(k)
                touched.add(q)
            words[k] = new = merged(old, p)
            for q in zip(new, new[1:], strict=False):
                pairs[q] += n[k]
                where[q].add(k)
                touched.add(q)
        for q in touched:
            if pairs[q] > 0:
                heapq.heappush(heap, (-pairs[q], q))
    return out


def bpe_merges_spread(counts: DataFrame, merges: int) -> list[tuple[str, str]]:
    """What ``bpe_merges`` gives, with the pairs of all words summed by Spark for each merge."""
    held = counts.persist()
    out: list[tuple[str, str]] = []
    try:
        while len(out) < merges:

            def pairs(batches: Iterator[pd.DataFrame], done: tuple[tuple[str, str], ...] = tuple(out)) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    found: Counter = Counter()
                    for word, n in zip(batch["word"], batch["n"], strict=True):
                        symbols = list(word)
                        for p in done:
                            symbols = merged(symbols, p)
                        for p in zip(symbols, symbols[1:], strict=False):
                            found[p] += n
                    yield pd.DataFrame([(a, b, n) for (a, b), n in found.items()], columns=["a", "b", "n"]).astype({"n": "int64"})

            top = held.mapInPandas(pairs, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "a", "b").limit(1).collect()
            if not top:
                break
            out.append((top[0]["a"], top[0]["b"]))
    finally:
        held.unpersist()
    return out


def merged(symbols: list[str], pair: tuple[str, str]) -> list[str]:
    out, i = [], 0
    while i < len(symbols):
        if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == pair:
            out.append(symbols[i] + symbols[i + 1])
            i += 2
        else:
            out.append(symbols[i])
            i += 1
    return out


def bpe_vocabulary(counts: DataFrame, merges: list[tuple[str, str]]) -> dict[str, int]:
    """Ids of specials, single characters in code-point order, and merges."""
    chars = counts.filter(~F.col("word").isin(SPECIALS)).select(F.explode(F.split("word", "")).alias("c")).filter("c <> ''").distinct().orderBy("c")
    return {w: i for i, w in enumerate([*SPECIALS, *(r["c"] for r in chars.collect()), *(a + b for a, b in merges)])}


def bpe_encoder(merges: list[tuple[str, str]], vocab: dict[str, int]):  # noqa: ANN201
    """A vectorised function from texts to ids; words that recur are encoded once for a batch."""
    rank = {p: i for i, p in enumerate(merges)}
    unk = vocab[UNK]

    def word_ids(word: str) -> list[int]:
        if word in vocab and word in SPECIALS:
            return [vocab[word]]
        symbols = list(word)
        while len(symbols) > 1:
            best = min(zip(symbols, symbols[1:], strict=False), key=lambda p: rank.get(p, len(rank)))
            if best not in rank:
                break
            symbols = merged(symbols, best)
        return [vocab.get(s, unk) for s in symbols]

    @F.pandas_udf("array<int>")
    def encoded(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, list[int]] = {}
        for batch in texts:
            out = []
            for text in batch:
                ids: list[int] = []
                for w in (text or "").split():
                    if w not in known:
                        if len(known) > 200_000:
                            known.clear()
                        known[w] = word_ids(w)
                    ids += known[w]
                out.append(ids)
            yield pd.Series(out)

    return encoded


def subword_encoder(path: str, most: int):  # noqa: ANN201
    """A vectorised function from texts to at most so many ids of a tokenizer file that the caller names."""

    @F.pandas_udf("array<int>")
    def encoded(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.enable_truncation(most)
        for batch in texts:
            yield pd.Series([x.ids for x in tok.encode_batch([t or "" for t in batch])])

    return encoded
