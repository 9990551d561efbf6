"""Operator 7: benchmark decontamination by template canonicalisation.

Texts become templates: words are runs of letters, digits and non-ASCII characters; a number, a unit or a name is
replaced by the placeholder of its type, other words are lower-cased. A name is a capitalised word inside a sentence.
Windows of WINDOW template words of the benchmark are kept by hash with all their places; documents' windows are looked
up by hash. Hits of a document that lie on one diagonal of an item (equal place in the document less place in the item)
are one alignment. An alignment is a leak if it covers LEAST_SHARE of the item's windows (or LEAST_WINDOWS of them in
long items) and its slots are consistent: where the item repeats a number, unit or name, the document repeats what
stands in its place, one to one, so that re-parameterised questions count and coincidences of placeholders don't.
Where slots are inconsistent, the alignment is split: its longest consistent run is a leak if it has twice LEAST_WINDOWS.
Windows of templates with fewer than PLAIN plain words tell little: they count only if all windows of the item match, it
has SHORTEST words, at least PLAIN_ITEM of them plain, and its slots are consistent. Windows of the words themselves,
lower-cased, are looked up as well, so dense questions and copies whose names lost or changed their case are found; as many
of them as a leak needs are one, whatever the slots.

The benchmark's windows go to the workers as one table if there are at most TABLE of them, which is counted; beyond, the
documents' windows are joined by shuffle. Both ways lead to the same check.

Defined results: null or empty texts and items match nothing; items with fewer than WINDOW words are one window of
their own length; those of fewer than SHORTEST words count with equal words only, and those of fewer than ANYWHERE words only
if they are the whole document, as a word or two stand in any text; a null item_id is an item; repeated items and rows each count; empty
tables give no rows (the stage: all documents); other columns are ignored by ``leaks`` and returned by ``decontaminate``.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.llm.common import Workspace, bound_batches, documents, mix

WINDOW = 8
PLAIN = 5  # plain words of a window at least
SHORTEST = 5
PLAIN_ITEM = 2  # plain words of an item whose windows don't tell
ANYWHERE = 3  # words of an item that is looked for within documents
LEAST_SHARE = 0.6
LEAST_WINDOWS = 6  # of a long item: thirteen words in a row
TABLE = 2_000_000
KEPT = 500_000  # words a worker keeps numbers of

#: Fixed list of unit words.
UNITS = frozenset(b"mm cm m km inch inches ft feet foot yard yards mile miles g kg mg lb lbs oz ton tons ml l liter liters litre litres s sec second seconds min minute minutes h hour hours day days week weeks month months year years usd eur gbp dollar dollars euro euros cent cents percent degree degrees kmh mph w kw kwh v volt volts".split())

WORD = re.compile(rb"[A-Za-z0-9\x80-\xff]+")
NUMBER = re.compile(rb"[0-9]+[a-z]{0,2}")

FOUND = "doc_id long, item_id long, windows long, of_windows long, at long, slots long"


class Template(NamedTuple):
    hashes: np.ndarray  # of template words; the placeholders of numbers, units and names are 1, 2 and 3
    surface: np.ndarray  # hashes of the lower-cased words themselves


def byte_table(members: bytes, high: bool = False) -> np.ndarray:
    """Which bytes are members; with high, all bytes from 128 on as well."""
    out = np.zeros(256, bool)
    out[list(members)] = True
    out[128:] = high
    return out


IN_WORD = byte_table(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", high=True)
ENDS_SENTENCE = byte_table(b'.!?:;\n"')
UPPER, LOWER = byte_table(bytes(range(65, 91))), byte_table(bytes(range(97, 123)), high=True)


class Canon:
    """Templates of texts. Recurring lower-cased words have numbers, under which their hashes are kept."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.kind, self.surface = (np.empty(1 << 12, np.uint64) for _ in range(2))

    def numbers(self, low: list[bytes]) -> np.ndarray:
        try:
            return np.fromiter(map(self.number.__getitem__, low), np.int64, len(low))
        except KeyError:
            pass
        if len(self.number) > KEPT:
            self.number.clear()
        new = list({w for w in low if w not in self.number})
        at = len(self.number)
        while at + len(new) > len(self.kind):
            self.kind, self.surface = (np.concatenate([x, np.empty_like(x)]) for x in (self.kind, self.surface))
        for i, w in enumerate(new, at):
            self.surface[i] = h = xxhash.xxh3_64_intdigest(w) | 8  # keeps clear of the placeholders
            self.kind[i] = 1 if 48 <= w[0] <= 57 and NUMBER.fullmatch(w) else 2 if w in UNITS else h
            self.number[w] = i
        return np.fromiter(map(self.number.__getitem__, low), np.int64, len(low))

    def template(self, blob: bytes) -> Template:
        n = self.numbers(WORD.findall(blob.lower() if blob.isascii() else blob.decode().lower().encode()))  # never splits a word
        if not len(n):
            return Template(np.empty(0, np.uint64), np.empty(0, np.uint64))
        hashes = self.kind[n]
        #: Capitalised words whose predecessor doesn't end a sentence are names.
        raw = np.frombuffer(blob, np.uint8)
        inside = np.concatenate([[False], IN_WORD[raw], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        second = np.minimum(starts + 1, len(raw) - 1)
        capital = np.flatnonzero(UPPER[raw[starts]] & LOWER[raw[second]] & (second < ends) & (hashes > 3))
        capital = capital[capital > 0]
        if len(capital):
            ended = np.concatenate([[0], np.cumsum(ENDS_SENTENCE[raw], dtype=np.int64)])
            hashes[capital[ended[starts[capital]] == ended[ends[capital - 1]]]] = 3
        return Template(hashes, self.surface[n])


STEP = np.uint64(0x9E3779B97F4A7C15)


def windows(t: Template, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each window of width words, of its template and of the words themselves, and whether it has enough plain words."""
    n = len(t.hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, bool)
    each = mix(np.stack([t.hashes, t.surface]))
    out = np.full((2, n), width, np.uint64)
    for i in range(width):
        out = out * STEP + each[:, i : i + n]
    out[1] ^= STEP  # keeps both kinds apart
    out = mix(out)
    plain = np.concatenate([[0], np.cumsum(t.hashes > 3)])
    return out[0], out[1], plain[width:] - plain[:-width] >= min(PLAIN, width)


class Item(NamedTuple):
    item_id: int | None
    template: Template
    width: int
    windows: int  # that tell
    tells: frozenset[int]
    all: int


def consistent(item: Template, doc: Template, a: int, b: int, n: int) -> tuple[bool, int]:
    """Whether the slots of n aligned words, from a in the item and b in the document, map one to one; their number."""
    there: dict[int, int] = {}
    back: dict[int, int] = {}
    slots = np.flatnonzero(item.hashes[a : a + n] <= 3)
    for i in slots:
        x, y = int(item.surface[a + i]), int(doc.surface[b + i])
        if there.setdefault(x, y) != y or back.setdefault(y, x) != x:
            return False, len(slots)
    return True, len(slots)


def longest_run(item: Template, doc: Template, shift: int, places: list[int], width: int) -> tuple[int, int, int]:
    """Windows of the longest run at sorted places whose slots map one to one, its first place and the end of its last."""
    pairs: dict[tuple[int, int], int] = defaultdict(int)
    there: dict[int, int] = {}
    back: dict[int, int] = {}
    slot = item.hashes <= 3
    x, y = item.surface.tolist(), doc.surface.tolist()
    best, first, left, right = (0, 0, 0), 0, places[0], places[0]  # the run's words are left to right
    for k, place in enumerate(places):
        while right < place + width:
            if slot[right]:
                a, b = x[right], y[right + shift]
                while there.get(a, b) != b or back.get(b, a) != a:
                    if slot[left]:
                        gone = x[left], y[left + shift]
                        pairs[gone] -= 1
                        if not pairs[gone]:
                            del there[gone[0]], back[gone[1]]
                    left += 1
                there[a], back[b] = b, a
                pairs[a, b] += 1
            right += 1
        while first < k and places[first] < left:
            first += 1
        if places[first] >= left:
            best = max(best, (k - first + 1, places[first], place + width), key=lambda r: r[0])
    return best


class Benchmark:
    """The benchmark's items, and its windows as sorted hashes with their places."""

    def __init__(self, rows: list[tuple[int | None, str | None]]) -> None:
        canon, hashes, owner, place = Canon(), [], [], []
        self.items: list[Item] = []
        for item_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
            t = canon.template((text or "").encode())
            width = min(WINDOW, len(t.hashes))
            if not width:
                continue
            h, words, tells = windows(t, width)
            at = np.flatnonzero(tells & (width >= SHORTEST))
            if len(words):
                hashes += [h, words]
                place += [np.arange(len(words))] * 2
                owner.append(np.full(2 * len(words), len(self.items)))
                self.items.append(Item(item_id, t, width, len(at), frozenset(at.tolist()), len(words)))
        join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.empty(0, kind)
        order = np.argsort(join(hashes, np.uint64), kind="stable")
        self.hashes, self.owner, self.place = join(hashes, np.uint64)[order], join(owner, np.int32)[order], join(place, np.int32)[order]
        self.widths = sorted({i.width for i in self.items})
        #: Most windows of documents are ruled out by their first bits.
        self.first = np.zeros(1 << 20, bool)
        self.first[self.hashes >> np.uint64(44)] = True

    def hits(self, doc: Template) -> Iterator[tuple[int, int, int, bool]]:
        """(item, place in the item, place in the document, whether the words are equal) of equal windows."""
        for width in self.widths:
            h, words, _ = windows(doc, width)
            if not len(h) or width < ANYWHERE and len(h) > 1:
                continue
            for x, equal in ((h, False), (words, True)):
                for at in np.flatnonzero(self.first[x >> np.uint64(44)]):
                    i = int(np.searchsorted(self.hashes, x[at]))
                    while i < len(self.hashes) and self.hashes[i] == x[at]:
                        yield int(self.owner[i]), int(self.place[i]), int(at), equal
                        i += 1

    def leaks(self, doc: Template) -> Iterator[tuple[int | None, int, int, int, int]]:
        """item_id, windows, of_windows, place and slots of each leaked item: its best alignment."""
        lines: dict[tuple[int, int], tuple[set[int], set[int]]] = defaultdict(lambda: (set(), set()))
        for item, a, b, equal in self.hits(doc):
            lines[item, b - a][equal].add(a)
        best: dict[int, tuple[int, int, int, int]] = {}
        for (k, shift), (alike, equal) in lines.items():
            found = self.aligned(self.items[k], doc, shift, alike, equal)
            if found:
                best[k] = max(best.get(k, (0, 0, 0, 0)), found)
        for k, (n, at, slots, of) in sorted(best.items()):
            yield self.items[k].item_id, n, of, -at, slots

    @staticmethod
    def aligned(item: Item, doc: Template, shift: int, alike: set[int], equal: set[int]) -> tuple[int, int, int, int] | None:
        """windows, -place, slots and of_windows of a leak on one diagonal, from places of windows with equal templates and words."""
        if len(equal) >= min(LEAST_WINDOWS, LEAST_SHARE * item.all):
            first, last = min(equal), max(equal) + item.width
            return len(equal), -(first + shift), int((item.template.hashes[first:last] <= 3).sum()), item.all
        if item.width < SHORTEST:
            return None
        places = alike | equal
        if len(places) == item.all and len(item.tells) < item.all:
            ok, slots = consistent(item.template, doc, 0, shift, len(item.template.hashes))
            if ok and (item.template.hashes > 3).sum() >= PLAIN_ITEM:
                return item.all, -shift, slots, item.all
        places &= item.tells
        if len(places) and len(places) >= min(LEAST_WINDOWS, LEAST_SHARE * item.windows):
            first, last = min(places), max(places) + item.width
            ok, slots = consistent(item.template, doc, first, first + shift, last - first)
            if ok:
                return len(places), -(first + shift), slots, item.windows
            if len(places) >= 2 * LEAST_WINDOWS:
                n, first, last = longest_run(item.template, doc, shift, sorted(places), item.width)
                if n >= 2 * LEAST_WINDOWS:
                    return n, -(first + shift), int((item.template.hashes[first:last] <= 3).sum()), item.windows
        return None


def matched(docs: DataFrame, bench: Benchmark) -> DataFrame:
    """Rows of FOUND of all documents, by the table of windows on the workers."""
    shared = docs.sparkSession.sparkContext.broadcast(bench)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon, known = Canon(), shared.value
        types = [pa.int64()] * 6
        for batch in batches:
            rows = [(doc_id, *x) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) if known.items for x in known.leaks(canon.template((text.as_py() or "").encode()))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "item_id", "windows", "of_windows", "at", "slots"])

    return docs.mapInArrow(match, FOUND)


def window_rows(texts: DataFrame, key: str) -> DataFrame:
    """key, hash of each window that an item could have, of templates and of words; texts: key, text, of any size of table."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon()
        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = canon.template((text.as_py() or "").encode())
                width = min(WINDOW, len(t.hashes))
                for w in {width} if key == "item_key" else {*range(ANYWHERE, WINDOW + 1), width}:
                    if w:
                        h = np.unique(np.concatenate(windows(t, w)[:2])).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array([k] * len(h), pa.int64()), pa.array(h)], names=[key, "hash"])

    return texts.mapInArrow(cut, f"{key} long, hash long")


def joined(docs: DataFrame, items: DataFrame, work: Workspace) -> DataFrame:
    """Rows of FOUND and doc_key by shuffle, for a benchmark too large for the workers' table.

    docs: doc_key, doc_id, text. Windows are joined by hash; the texts of each pair of a document and an item that share one
    are checked. Rows have keys of their own, so that null and repeated ids don't matter.
    """
    items = work.table(items.select(F.monotonically_increasing_id().alias("item_key"), "item_id", F.col("text").alias("item")), "items")
    shared = window_rows(docs.select("doc_key", "text"), "doc_key").join(window_rows(items.select("item_key", "item"), "item_key"), "hash")
    pairs = shared.select("doc_key", "item_key").distinct()
    both = pairs.join(items, "item_key").join(docs, "doc_key").select("doc_key", "doc_id", "text", "item_id", "item")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon()
        for batch in batches:
            rows = []
            for key, doc_id, text, item_id, item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(doc_id, *x, key) for x in Benchmark([(item_id, item)]).leaks(canon.template((text or "").encode()))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "item_id", "windows", "of_windows", "at", "slots", "doc_key"])

    return both.mapInArrow(match, f"{FOUND}, doc_key long")


def known(benchmark: DataFrame, table: int) -> tuple[DataFrame, Benchmark | None]:
    """The items, and the table of their windows if there are few enough."""
    bound_batches(benchmark.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    words = items.agg(F.coalesce(F.sum(F.size(F.split(F.col("text"), r"[^A-Za-z0-9\x{80}-\x{10FFFF}]+"))), F.lit(0))).first()[0]
    few = words <= table  # there are at most as many windows of either kind as words
    return items, Benchmark([(r["item_id"], r["text"]) for r in items.collect()]) if few else None


def leaks(docs: DataFrame, benchmark: DataFrame, table: int = TABLE) -> DataFrame:
    """Rows of FOUND: which document holds which item, how many of its windows, and where."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items, bench = known(benchmark, table)
    if bench is not None:
        return matched(docs, bench)
    work = Workspace(docs.sparkSession, "decontam")
    return joined(work.table(docs.select(F.monotonically_increasing_id().alias("doc_key"), "doc_id", "text"), "docs"), items, work).drop("doc_key")


def decontaminate(docs: DataFrame, benchmark: DataFrame, table: int = TABLE) -> DataFrame:
    """Documents that hold no item of the benchmark, row by row, whatever their ids."""
    items, bench = known(benchmark, table)
    if bench is not None:
        shared = docs.sparkSession.sparkContext.broadcast(bench)

        @F.arrow_udf("boolean")
        def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            canon = Canon()
            for texts in batches:
                yield pa.array([next(shared.value.leaks(canon.template((t.as_py() or "").encode())), None) is None for t in texts], pa.bool_())

        return docs.filter(clean(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    work = Workspace(docs.sparkSession, "decontaminate")
    held = work.table(docs.select(F.monotonically_increasing_id().alias("doc_key"), F.struct("*").alias("row")), "docs")
    texts = held.select("doc_key", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").cast("string").alias("text"))
    found = work.table(joined(texts, items, work).select("doc_key").distinct(), "leaked")
    return held.join(found, "doc_key", "left_anti").select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
