"""Operator 10: a class-based bigram model after Brown, with classes by exchange clustering.

Words are lower-cased (A-Z) runs of non-blank bytes; each text ends with one end token. Every word of the vocabulary has a
class of its own choice. The FREQUENT most frequent words, and GROUPS groups of the rest by last bytes, are exchanged one by
one until a round moves none, which gives first classes. From them the other words move one by one, in rounds over the
texts: each goes to the class that predicts its neighbours' classes best, its own counts taken out of the class that it is
in. Rounds of the TABLE most frequent words go on until the likelihood of the class bigrams rises by less than SETTLED of
itself; then the words beyond the table choose, by their neighbours in those classes. Counts of words and of neighbours come
from all training texts. There are CLASSES classes at least, and the cube root of the vocabulary if that is more.

    log10 P(text) = sum over tokens of  log10 P(class | class before) + log10 P(word | class)
    P(c | b) = (n(b, c) + 0.5) / (n(b) + 0.5 * classes)       P(w | c) = (n(w) + 1) / (n(c) + types(c) + 1)

Words of the whole vocabulary are told apart by 64-bit hashes, whose last bits are the word's group. The counts and classes
of at most TABLE frequent words go to every worker as one sorted table of bounded size; rarer words' counts and classes are
joined by shuffle, so none is left out. A word that isn't in the training texts has its group's class.

Two passes read the texts: one counts words, the other writes each word as the number of its item in the table, and the
hashes of the rarer ones; all others read these numbers.

Defined results: a null or empty text is its end token alone; rows with a null doc_id train and aren't held out; repeated
rows count each time and each give a row; a very long text is split into words piece by piece; of words with one count, of
which only some fit in the table, none does; without training texts every count is 0; an empty table gives no rows; columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.llm.common import Workspace, as_bytes, documents, fold_of, give_back, segments

FREQUENT = 500
GROUPS = 64
CLASSES = 32  # at least
SETTLED = 0.001  # rounds of words end when the likelihood rises by less than this share
TABLE = 1 << 19
PIECE = 16 << 20  # bytes of texts that are split into words at a time
END = np.uint64(0x9E3779B97F4A7C15)  # stands for the end token's hash
FLUSH = 1 << 20  # tokens that a worker gathers before it adds equal ones up
SLICE = 1 << 18  # tokens that are looked up at a time, if no text is longer
BUCKET = 200_000  # tokens to a bucket of words that move
WORDS = 2048  # words whose moves are weighed at a time

LOCAL = "doc_id long, held_out boolean, n_tokens long, known long, logs double, model double, rare array<long>, before array<int>, after array<int>"


def group_of(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(GROUPS - 1)).astype(np.int64)


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) & ~(GROUPS - 1) | zlib.crc32(word[-2:]) % GROUPS


class Split(NamedTuple):
    """Words of some texts: hashes of different ones, each word's place among them, and each text's number of words."""

    once: np.ndarray
    code: np.ndarray
    sizes: np.ndarray


def split_words(texts: pa.Array) -> Split:
    """The words of some texts, one after the other. Equal words are hashed once."""
    low = pc.ascii_lower(texts.cast(pa.large_string()).fill_null(""))
    split = pc.ascii_split_whitespace(low)
    ends = split.offsets.to_numpy().astype(np.int64)
    coded = split.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
    once = [w.encode() for w in coded.dictionary.to_pylist()]
    code = coded.indices.to_numpy()
    word = np.fromiter(map(len, once), np.int64, len(once)) > 0  # white space at a text's ends leaves empty strings
    real = word[code]
    below = np.concatenate([[0], np.cumsum(real)])
    return Split(np.fromiter(map(word_hash, once), np.uint64, len(once)), code[real], np.diff(below[ends - ends[0]]))


def words_of(texts: pa.Array) -> Split:
    """The same for texts of any length: those of an array above PIECE bytes are split piece by piece."""
    if texts.nbytes <= PIECE:
        return split_words(texts)
    parts, sizes, before = [], [], 0
    for blob in as_bytes(texts):
        sizes.append(0)
        for part in segments(blob, PIECE):
            own = split_words(pa.array([part.decode()]))
            parts.append((own.once, own.code + before))
            sizes[-1] += len(own.code)
            before += len(own.once)
    return Split(*(np.concatenate(x) for x in zip(*parts, strict=True)), np.array(sizes, np.int64))


class Summed:
    """Sums of counts by key, gathered in arrays and added up when they grow large."""

    def __init__(self) -> None:
        self.keys, self.counts, self.size = [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        keys, where = np.unique(np.concatenate(self.keys), return_inverse=True)
        return keys, np.bincount(where, np.concatenate(self.counts), len(keys)).astype(np.int64)


def word_counts(texts: DataFrame) -> DataFrame:
    """hash, grp, n of every word and the end token. texts: text."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, ends = Summed(), 0

        def out() -> pa.RecordBatch:
            keys, n = sums.total()
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(group_of(keys).astype(np.int32)), pa.array(n)], names=["hash", "grp", "n"])

        for batch in batches:
            ends += batch.num_rows
            words = words_of(batch.column(0))
            n = np.bincount(words.code, minlength=len(words.once))
            sums.add(words.once[n > 0], n[n > 0])
            if sums.size > FLUSH:  # what one task holds is bounded; the shuffle adds up the rest
                yield out()
                sums = Summed()
        yield out()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([int(END.view(np.int64))]), pa.array([-1], pa.int32()), pa.array([ends])], names=["hash", "grp", "n"])
        del sums
        give_back()

    return texts.mapInArrow(counted, "hash long, grp int, n long").groupBy("hash").agg(F.min("grp").alias("grp"), F.sum("n").alias("n"))


class Table(NamedTuple):
    """Counts of frequent words, sorted by hash, and the item of each: below FREQUENT for the most frequent ones."""

    hash: np.ndarray
    count: np.ndarray
    item: np.ndarray

    def of_items(self, values: np.ndarray) -> np.ndarray:
        """Values of the table's words by their items; 0 for other items."""
        out = np.zeros(ITEMS + max(0, len(self.hash) - FREQUENT), values.dtype)
        out[self.item] = values
        return out

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 for a rarer word."""
        if not len(self.hash):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[at] == h, at, -1)

    def items(self, h: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Item of each word: its own, or its group's for a word beyond the table."""
        at = self.find(h)
        return np.where(at >= 0, self.item[at], FREQUENT + group) if len(self.hash) else FREQUENT + group


ITEMS = FREQUENT + GROUPS + 1  # frequent words, groups, the boundary between texts; the table's other words follow
EDGE = ITEMS - 1


def frequent(counts: DataFrame) -> Table:
    """The table of all words from some count on, that count being the least for which at most TABLE words qualify."""
    level = F.floor(F.log2("n") * 8).cast("int")
    seen = counts.filter("grp >= 0").groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("level")).collect()
    total, least = 0, None
    for r in seen:  # one row for each eighth of a power of two
        total += r["words"]
        if total > TABLE:
            break
        least = r["level"]
    if least is None:
        return Table(np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 2)
    got = counts.filter("grp >= 0").filter(level >= least).select("hash", "grp", "n").toArrow()
    h, n = got["hash"].to_numpy().view(np.uint64), got["n"].to_numpy()
    rank = np.lexsort((h, -n))
    item = np.empty(len(h), np.int64)
    item[rank] = np.arange(len(rank)) + np.where(np.arange(len(rank)) < FREQUENT, 0, ITEMS - FREQUENT)
    order = np.argsort(h)
    return Table(h[order], n[order], item[order])


def coded(docs: DataFrame, table: Callable[[], Table]) -> DataFrame:
    """docs with items, of the words of each text, in the place of the last column, the text; and rare, the hashes of those
    words that aren't in the table. Both are bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table()
        binary = lambda x, ends: pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends * x.itemsize), pa.py_buffer(x)]).cast(pa.binary())
        for batch in batches:
            words = words_of(batch.column(batch.num_columns - 1))
            items = known.items(words.once, group_of(words.once)).astype(np.int32)[words.code]
            rare = is_rare(items)
            ends = np.concatenate([[0], np.cumsum(words.sizes)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], binary(items, ends), binary(words.once[words.code[rare]], np.concatenate([[0], np.cumsum(rare)])[ends])], names=names)
        give_back()

    names = [*docs.columns[:-1], "items", "rare"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1])
    return docs.mapInArrow(cut, f"{kinds}{', ' if kinds else ''}items binary, rare binary")


def is_rare(items: np.ndarray) -> np.ndarray:
    return (items >= FREQUENT) & (items < EDGE)


class Slice(NamedTuple):
    """Some texts of a batch, from first to last: their words' items, one after the other, the hashes of the rare ones among
    them, and each text's length."""

    batch: pa.RecordBatch
    first: int
    items: np.ndarray
    rare: np.ndarray
    sizes: np.ndarray

    def texts(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def places(self) -> np.ndarray:
        """Place of each word if a boundary stands before each text and after the last one."""
        return np.arange(len(self.items)) + self.texts() + 1


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Slice]:
    """Slices of SLICE words, or one text, of rows that end with items and rare."""

    def numbers(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
        size = np.dtype(kind).itemsize
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // size
        whole = column.buffers()[2]
        return ends, np.frombuffer(whole, kind, len(whole) // size) if whole else np.empty(0, kind)

    for batch in batches:
        ends, items = numbers(batch.column(batch.num_columns - 2), np.int32)
        rare_ends, rare = numbers(batch.column(batch.num_columns - 1), np.uint64)
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + SLICE, "right")) - 1)
            yield Slice(batch, first, items[ends[first] : ends[last]], rare[rare_ends[first] : rare_ends[last]], np.diff(ends[first : last + 1]))
            first = last


def neighbours(texts: DataFrame, table: Callable[[], Table]) -> np.ndarray:
    """Counts of neighbouring items over all texts, boundaries included; words that aren't the most frequent by group."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums = table(), np.zeros(ITEMS * ITEMS, np.int64)
        by_group = FREQUENT + known.of_items(group_of(known.hash))
        by_group[:ITEMS] = np.arange(ITEMS)
        for s in slices(batches):
            line = np.full(len(s.items) + len(s.sizes) + 1, EDGE)
            line[s.places()] = by_group[s.items]
            sums += np.bincount(line[:-1] * ITEMS + line[1:], minlength=ITEMS * ITEMS)
        full = np.flatnonzero(sums)
        if len(full):
            yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(sums[full])], names=["pair", "n"])

    got = texts.mapInArrow(counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(ITEMS * ITEMS, np.int64)
    out[got["pair"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(ITEMS, ITEMS)


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """Class of each item by exchange clustering until none moves. The boundary keeps class 0 to itself."""
    bigrams = bigrams.astype(np.float64)
    items = np.argsort(-bigrams.sum(axis=1), kind="stable")
    items = items[items != EDGE]
    of = np.zeros(len(bigrams), np.int64)
    of[items] = 1 + np.arange(len(items)) % (classes - 1)
    one = np.eye(classes)
    right, left = bigrams @ one[of], bigrams.T @ one[of]  # by item: counts of the classes after and before it
    m = one[of].T @ right
    moved = 1
    while moved:  # each move raises the likelihood, so this ends
        moved = 0
        for w in items:
            a, own = of[w], bigrams[w, w]
            r, l = right[w].copy(), left[w].copy()
            r[a] -= own
            l[a] -= own
            m[a, :] -= r
            m[:, a] -= l
            m[a, a] -= own
            was = xlogx(m)
            rows, cols = m.sum(axis=1), m.sum(axis=0)
            gain = (xlogx(m + r) - was).sum(axis=1) + (xlogx(m + l[:, None]) - was).sum(axis=0)
            d = np.diag(m)
            gain += xlogx(d + r + l + own) - xlogx(d + r) - xlogx(d + l) + xlogx(d)
            gain -= xlogx(rows + r.sum() + l + own) - xlogx(rows + l) + xlogx(cols + l.sum() + r + own) - xlogx(cols + r)
            gain[0] = -np.inf
            b = a if gain.max() <= gain[a] + 1e-9 else int(gain.argmax())
            m[b, :] += r
            m[:, b] += l
            m[b, b] += own
            if a != b:
                of[w] = b
                moved += 1
                right[:, a] -= bigrams[:, w]
                right[:, b] += bigrams[:, w]
                left[:, a] -= bigrams[w, :]
                left[:, b] += bigrams[w, :]
    return of


class Classes(NamedTuple):
    table: Table
    of: np.ndarray  # class of each item
    n: int


CONTEXT = "bucket int, words binary, sizes binary, codes binary, ns binary"
DEAL = 0x9E3779B1  # odd, so that it has an inverse modulo 2 ** 32
BACK = pow(DEAL, -1, 1 << 32)


def dealt(items: np.ndarray) -> np.ndarray:
    """Numbers of 32 bits for items, one to one, whose first bits deal them out evenly."""
    return items.astype(np.int64) * DEAL & 0xFFFFFFFF


def undealt(numbers: np.ndarray) -> np.ndarray:
    return (numbers.astype(np.uint64) * np.uint64(BACK) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def class_lines(s: Slice, known: Classes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes with a boundary before each text and after the last; whether that is a rare word's group's; places of words."""
    at = s.places()
    line, rare = np.full(len(s.items) + len(s.sizes) + 1, known.of[EDGE]), np.zeros(len(s.items) + len(s.sizes) + 1, bool)
    line[at], rare[at] = known.of[s.items], is_rare(s.items)
    return line, rare, at


def bigrams_of(texts: DataFrame, known: Callable[[], Classes]) -> tuple[np.ndarray, np.ndarray]:
    """Class bigrams of words in the table, and those with a rare word, which counts for its group's class."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = known()
        n, sums = now.n, np.zeros(2 * now.n**2, np.int64)
        for s in slices(batches):
            line, rare, _ = class_lines(s, now)
            sums += np.bincount(line[:-1] * n + line[1:] + n * n * (rare[:-1] | rare[1:]), minlength=2 * n * n)
        full = np.flatnonzero(sums)
        if len(full):
            yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(sums[full])], names=["pair", "n"])

    got = texts.mapInArrow(counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    n = known().n
    out = np.zeros(2 * n * n, np.float64)
    out[got["pair"].to_numpy()] = got["n"].to_numpy()
    return out[: n * n].reshape(n, n), out[n * n :].reshape(n, n)


def contexts(texts: DataFrame, known: Callable[[], Classes], beyond: bool, buckets: int) -> DataFrame:
    """Rows of CONTEXT: how often each code of a neighbour stands beside each word that moves, by bucket of the word's hash.

    The words are those of the table but the most frequent, or those beyond it. Codes are the class after, or classes + the
    class before; 2 * classes more for a rare neighbour, whose class is its group's here.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = known(), [], 0

        def rows() -> pa.RecordBatch:
            names, code = (np.concatenate(c) for c in zip(*held, strict=True))
            if beyond:  # a hash and a code are no one number
                once, word = np.unique(names, return_inverse=True)
                keys, n = np.unique(word * (4 * now.n) + code, return_counts=True)
                word = keys // (4 * now.n)
            else:
                keys, n = np.unique(names * (4 * now.n) + code, return_counts=True)
                once, word = np.unique(keys // (4 * now.n), return_inverse=True)
                once = once.astype(np.uint32)
            sizes = np.bincount(word, minlength=len(once))
            bucket = (once >> np.uint64(32) if beyond else once.astype(np.uint64)) * np.uint64(buckets) >> np.uint64(32)
            first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            ends, below = np.append(first, len(once)), np.concatenate([[0], np.cumsum(sizes)])
            cut = lambda x, ends: pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(x)])
            packed = [cut(once, ends), cut(sizes.astype(np.int16), ends), cut((keys % (4 * now.n)).astype(np.int16), below[ends]), cut(n.astype(np.int32), below[ends])]
            return pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), *packed], names=["bucket", "words", "sizes", "codes", "ns"])

        for s in slices(batches):
            line, rare, at = class_lines(s, now)
            moves = is_rare(s.items) if beyond else s.items >= ITEMS
            at, names = at[moves], s.rare if beyond else dealt(s.items[moves])
            for beside, shift in ((at + 1, 0), (at - 1, now.n)):
                held.append((names, shift + line[beside] + 2 * now.n * rare[beside]))
            size += 2 * len(names)
            if size >= FLUSH:
                yield rows()
                held, size = [], 0
        if size:
            yield rows()
        del held
        give_back()

    return texts.mapInArrow(counted, CONTEXT)


def rare_pairs(texts: DataFrame, known: Callable[[], Classes]) -> DataFrame:
    """hash, next of words beyond the table that stand in a row."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = known()
        for s in slices(batches):
            _, rare, at = class_lines(s, now)
            own = rare[at]
            both = np.flatnonzero(own & rare[at + 1])
            if len(both):
                place = (np.cumsum(own) - 1)[both]
                yield pa.RecordBatch.from_arrays([pa.array(s.rare[x].view(np.int64)) for x in (place, place + 1)], names=["hash", "next"])

    return texts.mapInArrow(found, "hash long, next long")


def likelihood(m: np.ndarray) -> float:
    """Of class bigrams, up to what doesn't depend on classes."""
    return float(xlogx(m).sum() - xlogx(m.sum(axis=0)).sum() - xlogx(m.sum(axis=1)).sum())


def best_classes(own: np.ndarray, right: np.ndarray, left: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The class of each word that predicts its neighbours best. right, left: by word, counts of classes after and before."""
    n = len(m)
    rows, cols, log = m.sum(axis=1), m.sum(axis=0), np.log(m + 0.5)
    r, l = right.sum(axis=1), left.sum(axis=1)
    gain = right @ log.T + left @ log - r[:, None] * np.log(rows + 0.5 * n) - l[:, None] * np.log(cols + 0.5 * n)
    less = lambda x, y: np.log(np.maximum(x - y, 0) + 0.5)
    less_all = lambda x, y: np.log(np.maximum(x - y, 0) + 0.5 * n)
    stay = (right * less(m[own], right)).sum(axis=1) + (left * less(m.T[own], left)).sum(axis=1) - r * less_all(rows[own], r) - l * less_all(cols[own], l)
    gain[np.arange(len(own)), own] = stay
    gain[:, 0] = -np.inf  # the boundary's
    best = gain.argmax(axis=1)
    return np.where(gain[np.arange(len(own)), best] > stay + 1e-9, best, own)


def moved(rows: DataFrame, known: Callable[[], Classes], beyond: bool, m: np.ndarray) -> DataFrame:
    """hash (or item of a word in the table), cls of each word in rows of CONTEXT; with hash null, cls is a bigram of classes
    and n its count."""
    n = len(m)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = known(), np.zeros(n * n, np.int64)

        def words(parts: list[list[bytes]]) -> pa.RecordBatch:
            kinds = (np.uint64 if beyond else np.uint32, np.int16, np.int16, np.int32)
            names, sizes, code, count = (np.frombuffer(b"".join(c), t) for c, t in zip(zip(*parts, strict=True), kinds, strict=True))
            once, word = np.unique(names, return_inverse=True)
            of = np.repeat(word, sizes)
            order = np.argsort(of, kind="stable")
            of, code, count = of[order], code[order].astype(np.int64), count[order]
            own = now.of[FREQUENT + group_of(once)] if beyond else now.of[once := undealt(once)]
            best = np.empty(len(once), np.int64)
            for at in range(0, len(once), WORDS):
                a, b = np.searchsorted(of, [at, at + WORDS])
                k = min(WORDS, len(once) - at)
                full = np.bincount((of[a:b] - at) * 2 * n + code[a:b] % (2 * n), count[a:b], k * 2 * n).reshape(k, 2 * n)
                best[at : at + k] = best_classes(own[at : at + k], full[:, :n], full[:, n:], m)
            certain = code < 2 * n
            mine, code, count = best[of[certain]], code[certain], count[certain]
            sums[:] += np.bincount(np.where(code < n, mine * n + code, (code - n) * n + mine), count, n * n).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(once.view(np.int64)), pa.array(best.astype(np.int32)), pa.array(np.zeros(len(once), np.int64))], names=["hash", "cls", "n"])

        bucket, parts = None, []
        for batch in batches:  # of bounded bytes
            for b, *part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if parts and b != bucket:
                    yield words(parts)
                    parts = []
                bucket = b
                parts.append(part)
        if parts:
            yield words(parts)
        full = np.flatnonzero(sums)
        if len(full):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(full), pa.int64()), pa.array(full.astype(np.int32)), pa.array(sums[full])], names=["hash", "cls", "n"])

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(move, "hash long, cls int, n long")


class ClassModel(NamedTuple):
    table: Table
    of: np.ndarray  # class of each item
    step: np.ndarray  # log10 P(class | class before)
    among: np.ndarray  # log10 (n(class) + types(class) + 1)
    rarer: DataFrame  # hash, cls of the words beyond the table


def learn(rows: DataFrame, work: Workspace) -> tuple[ClassModel, DataFrame, DataFrame, int, int]:
    """The model, the counts of all words, the coded rows, and the numbers of training tokens and of different ones.

    rows: any columns, trains (boolean), text.
    """
    spark = rows.sparkSession
    counts = work.table(word_counts(rows.filter("trains").select("text")), "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n = max(CLASSES, min(ITEMS // 2, round(total["v"] ** (1 / 3))))
    table = frequent(counts)
    shared = spark.sparkContext.broadcast(table)
    rows = work.table(coded(rows, lambda: shared.value), "items")
    texts = rows.filter("trains").select("items", "rare")
    first = exchange(neighbours(texts, lambda: shared.value), n)
    of = np.concatenate([first, first[FREQUENT + table.of_items(group_of(table.hash))[ITEMS:]]])
    buckets = 12 + total["n"] // BUCKET
    most, before = -np.inf, None
    while True:
        held = spark.sparkContext.broadcast(Classes(table, of, n))
        known = lambda held=held: held.value
        m, unsure = bigrams_of(texts, known)
        now = likelihood(m + unsure)
        if before is not None and now < most:
            of, m, unsure, known = before  # moves at once did harm: the round before stands
            break
        if now - most < SETTLED * abs(now):
            break
        most, before = now, (of, m, unsure, known)
        got = moved(contexts(texts, known, False, buckets), known, False, m + unsure).filter("hash IS NOT NULL").select("hash", "cls").toArrow()
        of = of.copy()
        of[got["hash"].to_numpy()] = got["cls"].to_numpy()
        if (of == before[0]).all():
            break
    rare = work.table(moved(contexts(texts, known, True, buckets), known, True, m + unsure), "rarer")
    rarer = rare.filter("hash IS NOT NULL").select("hash", "cls")
    for r in rare.filter("hash IS NULL").groupBy("cls").agg(F.sum("n").alias("n")).collect():  # at most classes ** 2 rows
        m.ravel()[r["cls"]] += r["n"]
    beside = rare_pairs(texts, known).join(rarer, "hash").select(F.col("cls").alias("left"), F.col("next").alias("hash"))
    for r in beside.join(rarer, "hash").groupBy("left", "cls").agg(F.count(F.lit(1)).alias("n")).collect():
        m[r["left"], r["cls"]] += r["n"]
    types = np.bincount(of[table.item], minlength=n).astype(np.float64)
    for r in rarer.groupBy("cls").count().collect():
        types[r["cls"]] += r["count"]
    step = np.log10((m + 0.5) / (m.sum(axis=1, keepdims=True) + 0.5 * n))
    return ClassModel(table, of, step, np.log10(m.sum(axis=0) + types + 1), rarer), counts, rows, total["n"], total["v"]


def train(texts: DataFrame, work: Workspace) -> tuple[ClassModel, DataFrame, int, int]:
    """What ``learn`` gives, but the rows, from the column text."""
    model, counts, _, n, v = learn(texts.select(F.lit(True).alias("trains"), "text"), work)
    return model, counts, n, v


def score(docs: DataFrame, trains: Column, held_out: Column) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    spark, work = docs.sparkSession, Workspace(docs.sparkSession, "class-lm")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.coalesce(trains, F.lit(False)).alias("trains"), F.col("text").cast("string").alias("text"))
    model, counts, rows, n_train, n_types = learn(rows, work)
    shared = spark.sparkContext.broadcast(model._replace(rarer=None))
    n_ends = counts.filter("grp < 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        logs_of = np.log10(m.table.of_items(m.table.count) + 1.0)
        for s in slices(batches):
            texts, k = s.texts(), len(s.sizes)
            place, c, rare = s.places(), m.of[s.items], is_rare(s.items)
            line, gap = np.full(len(c) + k + 1, m.of[EDGE]), np.zeros(len(c) + k + 1, bool)
            line[place], gap[place] = c, rare
            steps = np.where(gap[:-1] | gap[1:], 0.0, m.step[line[:-1], line[1:]])
            logs = logs_of[s.items]  # 0 for rare ones
            summed = lambda x, texts=texts, k=k: np.bincount(texts, x, k)
            word_logs = summed(logs)
            model_logs = word_logs - summed(np.where(rare, 0.0, m.among[c])) + np.bincount(np.repeat(np.arange(k), s.sizes + 1), steps, k)
            at = place[rare]
            ends = pa.array(np.concatenate([[0], np.cumsum(summed(rare))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (s.rare.view(np.int64), *(np.where(gap[x], -1, line[x]).astype(np.int32) for x in (at - 1, at + 1)))]
            known = (summed(~rare) + int(n_ends > 0)).astype(np.int64)
            arrays = [*(s.batch.column(i).slice(s.first, k) for i in range(2)), pa.array(s.sizes + 1), pa.array(known), pa.array(word_logs + np.log10(n_ends + 1.0)), pa.array(model_logs), *lists]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "n_tokens", "known", "logs", "model", "rare", "before", "after"])

    local = rows.select("doc_id", "held_out", "items", "rare").mapInArrow(scored, LOCAL)
    local = work.table(local.withColumn("uid", F.monotonically_increasing_id()), "local")
    #: Each word beyond the table gets its count and class by a join; a word that wasn't trained on, its group's class.
    held = counts.join(model.rarer, "hash").select("hash", "n", "cls")
    by_group = F.array(*(F.lit(int(c)) for c in model.of[FREQUENT:EDGE]))
    classed = lambda of, h: F.coalesce(of, F.get(by_group, h.bitwiseAND(GROUPS - 1).cast("int")))
    steps = F.broadcast(spark.createDataFrame([(int(b), int(c), float(x)) for (b, c), x in np.ndenumerate(model.step)], "b int, c int, step double"))
    among = F.broadcast(spark.createDataFrame([(int(c), float(x)) for c, x in enumerate(model.among)], "c int, among double"))
    each = local.select("uid", "rare", F.posexplode(F.arrays_zip("rare", "before", "after")).alias("pos", "x"))
    each = each.select("uid", F.col("x.rare").alias("hash"), F.col("x.before").alias("before"), F.col("x.after").alias("after"), F.when(F.col("x.after") < 0, F.get("rare", F.col("pos") + 1)).alias("next"))
    single = each.join(held, "hash", "left").withColumn("c", classed(F.col("cls"), F.col("hash"))).join(among, "c")
    for side, b, c in (("before", "before", "c"), ("after", "c", "after")):
        single = single.join(steps.toDF("b", "e", f"step_{side}"), (F.col(b) == F.col("b")) & (F.col(c) == F.col("e")), "left").drop("b", "e")
    logs, zero = F.log10(F.coalesce("n", F.lit(0)) + 1), F.lit(0.0)
    single = single.select("uid", F.col("n").isNotNull().cast("long").alias("known"), logs.alias("logs"), (logs - F.col("among") + F.coalesce("step_before", zero) + F.coalesce("step_after", zero)).alias("model"))
    double = each.filter("next IS NOT NULL").select("uid", "hash", "next").join(held.select("hash", F.col("cls").alias("cls_left")), "hash", "left")
    double = double.select("uid", classed(F.col("cls_left"), F.col("hash")).alias("b"), F.col("next").alias("hash")).join(held.select("hash", "cls"), "hash", "left")
    double = double.withColumn("c", classed(F.col("cls"), F.col("hash"))).join(steps, ["b", "c"]).select("uid", F.lit(0).cast("long").alias("known"), zero.alias("logs"), F.col("step").alias("model"))
    found = single.unionByName(double).groupBy("uid").agg(F.sum("known").alias("more"), F.sum("logs").alias("more_logs"), F.sum("model").alias("more_model"))
    more, more_logs, more_model = (F.coalesce(c, z) for c, z in (("more", F.lit(0)), ("more_logs", zero), ("more_model", zero)))
    return local.join(found, "uid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + more).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("logs") + more_logs - F.col("n_tokens") * F.lit(float(np.log10(n_train + n_types + 1)))).alias("base_score"),
        (F.col("model") + more_model).alias("score"),
        F.pow(F.lit(10.0), -(F.col("model") + more_model) / F.col("n_tokens")).alias("perplexity"),
    )


def op10_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(fold_of(F.col("doc_id"), 7) == 2, F.lit(False))
    return score(docs, ~held_out, held_out)
