"""Operator 1: near-duplicates by b-bit MinHash, confirmed on full shingle sets.

1. One pass makes a sketch of each document: size and fingerprint of its set of shingles, the keys of its bands (the
   minima under ROWS permutations each) and its signature, the low BITS bits of all minima, packed.
2. Documents with equal sets form a class; the smallest id stands for it. Everything below is about representatives, so
   any number of copies costs one row each.
3. Representatives that share a band's key form a bucket. Each member is compared with its buckets' hubs only: with the
   hub of the largest estimated similarity, a hub being the member whose buckets are the largest. Similarities are
   estimated by bit counts of the signatures' differences, corrected for chance collisions; what lies MARGIN below the
   limit is no candidate, the rest is confirmed on full sets. Confirmed links make components.
4. Hubs whose buckets still hold several components have their members searched in blocks, those outside a hub's largest
   component against each other and against the rest. Blocks of signatures come first: what has no possible partner in
   another component is done. What remains is searched again with its full sets: pairs of different components that may
   be linked are confirmed inside the task, and only links that join components leave it. After that no pair of a bucket
   is left unjudged, unless its two documents are connected anyway.

Near-duplicates share no bucket with probability (1 - 0.8 ** ROWS) ** BANDS at the limit, 5e-8 with 4 rows and 32 bands.
Hubs of many members are replicated and their members dealt out, so no hub's links meet in one task.

Defined results: a document without words or text has an empty set and is linked with nothing; rows with a null doc_id
are left out of the links and keep a null component; rows that repeat a doc_id are one node, with a row each; an empty
table gives no rows; ties go to the smallest id; very long texts are cut into words piece by piece, their sets are whole;
other columns are ignored by ``near_duplicates`` and returned by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.llm.common import Workspace, as_bytes, documents, give_back, mix, window_hashes, word_hashes

SHINGLE = 5
LIMIT = 80  # per cent of the union that linked documents have in common
BANDS, ROWS, BITS = 32, 4, 2
PERMUTATIONS = BANDS * ROWS
MARGIN = 0.21  # five standard deviations of the estimate at the limit
BLOCK = 256  # members of a hub that are compared on full sets with as many at a time
SKETCHED = 2048  # those that are compared by signatures
MEMBERS = 64  # of a hub that a replica of it is confirmed with
BROADCAST_IDS = 2_000_000

_rng = np.random.default_rng(20)
XOR = _rng.integers(0, 1 << 64, PERMUTATIONS, np.uint64)
MULTIPLY = _rng.integers(0, 1 << 64, PERMUTATIONS, np.uint64) | np.uint64(1)

WORDS = PERMUTATIONS * BITS // 64  # 64-bit numbers of a signature
SIGNATURE = [f"g{i}" for i in range(WORDS)]

SKETCH = "doc_id long, text_hash long, n long, print binary, bands array<long>, signature array<long>"


def shingle_set(blob: bytes, width: int) -> np.ndarray:
    """Sorted hashes of a text's different shingles."""
    return np.unique(window_hashes(word_hashes(blob), width))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of a set under each permutation."""
    least = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):
        part = shingles[at : at + 512]
        np.minimum(least, ((part[None, :] ^ XOR[:, None]) * MULTIPLY[:, None]).min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, other bands having other keys."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for column in least.reshape(BANDS, ROWS).T:
        key = mix(key ^ column) + column
    return mix(key).view(np.int64)


def packed(least: np.ndarray) -> np.ndarray:
    """The low BITS bits of the minima, after mixing, as WORDS numbers; each bit has a plane of its own."""
    low = mix(least)
    planes = [np.packbits((low >> np.uint64(b) & np.uint64(1)).astype(np.uint8)) for b in range(BITS)]
    return np.concatenate(planes).view(np.int64)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for blob in as_bytes(batch.column(2)):
                s = shingle_set(blob, width)
                if len(s):
                    least = minima(s)
                    rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), band_keys(least).tolist(), packed(least).tolist()))
                else:
                    rows.append((0, None, None, None))
            if rows:
                types = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=["doc_id", "text_hash", "n", "print", "bands", "signature"])
        give_back()

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(sketched, SKETCH)


def limit_unequal(limit: int) -> int:
    """Differing positions of a pair that may be linked, at most: estimates are corrected for chance collisions."""
    return int(np.ceil(PERMUTATIONS * (1 - (limit / 100 - MARGIN)) * (1 - 2.0**-BITS)))


def may_link(a: list[Column], n_a: Column, b: list[Column], n_b: Column, limit: int) -> tuple[Column, Column]:
    """Whether a pair's sizes and estimate allow a link, and its differing positions."""
    half = WORDS // BITS
    apart = sum((F.bit_count(a[i].bitwiseXOR(b[i]).bitwiseOR(a[half + i].bitwiseXOR(b[half + i]))) for i in range(half)), F.lit(0))
    return (F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * limit) & (apart <= limit_unequal(limit)), apart


def only_stars(pairs: DataFrame) -> bool:
    """Whether no node of different edges u > v has two edges to smaller nodes, or one and another to a larger node."""
    ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(pairs.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not ends.agg(F.bool_or(F.expr("up + down > 1 AND up > 0"))).first()[0]


def components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """node, component (the smallest node it is connected with) of all nodes of edges a, b.

    Large and small stars by turns: every node's larger neighbours, then its smaller ones, are tied to the smallest it
    knows. Each turn's edges are written, so lineage stays short; it ends when there are only stars, which no turn changes
    and which the least nodes that go down with every turn bring about. Edges that are stars already take no turn.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    for turn in count():
        if only_stars(pairs):
            break
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("m"))
        large = both.join(least, both.u == least.node).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), "m")
        small = large.join(least, large.u == least.node).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        small = small.unionByName(least.select(F.col("node").alias("u"), F.col("m").alias("v"))).distinct()
        pairs = work.table(small, f"{name}-{turn}")
    nodes = pairs.groupBy("u").agg(F.min("v").alias("component"))
    roots = nodes.select(F.col("component").alias("u")).distinct().withColumn("component", F.col("u"))
    return nodes.unionByName(roots).groupBy(F.col("u").alias("node")).agg(F.min("component").alias("component"))


def sized(ids: DataFrame) -> DataFrame:
    """Broadcast ids up to a counted bound; a shuffle join beyond."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def full_sets(ids: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """node, shingles: the whole sets of the documents in ids (doc_id, different ones)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # small batches: sets are larger than texts
                part = batch.slice(at, 64)
                found = [shingle_set(x, width).tobytes() for x in as_bytes(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], names=["node", "shingles"])
        give_back()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(sized(ids), "doc_id", "left_semi")
    return texts.mapInArrow(sets, "node long, shingles binary")


def confirm(pairs: DataFrame, docs: DataFrame, width: int, limit: int, work: Workspace, name: str) -> DataFrame:
    """Those of the pairs a, b whose full sets have at least limit per cent of their union in common."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(k)[i].as_py(), np.uint64) for k in (2, 3))
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                keep.append(100 * both >= limit * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    full = work.table(full_sets(ids, docs, width), f"{name}-sets")
    #: The side with more links is replicated for every MEMBERS of them, and its members are dealt to the replicas.
    degree = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("replicas"))
    members = pairs.join(degree, "b").withColumn("replica", F.pmod(F.xxhash64("a"), F.col("replicas")).cast("int"))
    members = members.join(full.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a").select("a", "b", "replica", "of_a")
    hubs = degree.join(full.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b")
    hubs = hubs.select("b", F.explode(F.sequence(F.lit(0), F.col("replicas") - 1)).alias("replica"), "of_b")
    met = members.join(hubs, ["b", "replica"]).select("a", "b", "of_a", "of_b")
    return work.table(met.mapInArrow(linked, "a long, b long").distinct(), f"{name}-links")


def overlaps(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Number of elements that each of the other sorted sets has in common with one."""
    joined = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, joined), len(one) - 1)
    first = np.concatenate([[0], np.cumsum([len(o) for o in others])[:-1]])
    return np.add.reduceat((one[at] == joined).astype(np.int64), first)


DEALT = ["hub", "lo", "hi", "side", "node", "component", "n", *SIGNATURE]


def deal(members: DataFrame, sketch_of: DataFrame, block: int, work: Workspace, name: str) -> DataFrame:
    """Rows of DEALT: members (hub, node, component) in pairs of blocks, so that pairs of different components meet.

    Members of a hub's largest component meet those of the others only; hubs of one component have no rows. There is a row
    of sizes for each hub with several, which goes to the members, so that a large hub's don't go to one task.
    """
    sizes = members.groupBy("hub", "component").agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.groupBy("hub").agg(F.sum("size").alias("total"), F.max(F.struct("size", (-F.col("component")).alias("minus"))).alias("top"))
    sizes = sizes.filter(F.col("total") > F.col("top.size")).select("hub", (-F.col("top.minus")).alias("main"), F.ceil((F.col("total") - F.col("top.size")) / block).cast("int").alias("others"), F.ceil(F.col("top.size") / block).cast("int").alias("mains"))
    rows, place = members.join(sized(work.table(sizes, f"{name}-sizes")), "hub"), F.xxhash64("node")
    inside = F.col("component") == F.col("main")
    rows = rows.withColumn("side", F.when(inside, F.col("others") + F.pmod(place, F.col("mains"))).otherwise(F.pmod(place, F.col("others"))).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(inside, F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1)))
    rows = rows.withColumn("lo", F.least("side", "other")).withColumn("hi", F.greatest("side", "other"))
    return rows.join(sketch_of, "node").select(*DEALT)


Group = dict[str, np.ndarray]


def by_blocks(rows: DataFrame, judge: Callable[[Group], list[tuple[int, int]]], names: tuple[str, str]) -> DataFrame:
    """What judge says of the rows of each pair of blocks, as two columns of numbers."""
    columns = rows.columns

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Group | None = None

        def groups(x: Group, last: bool) -> Iterator[Group]:
            nonlocal held
            new = np.flatnonzero((x["hub"][1:] != x["hub"][:-1]) | (x["lo"][1:] != x["lo"][:-1]) | (x["hi"][1:] != x["hi"][:-1])) + 1
            cuts = [0, *new.tolist(), len(x["hub"])]
            for at, to in zip(cuts[: None if last else -1], cuts[1 : None if last else -1], strict=False):
                yield {k: v[at:to] for k, v in x.items()}
            held = None if last else {k: v[cuts[-2] :] for k, v in x.items()}

        def send(x: Group, last: bool) -> Iterator[pa.RecordBatch]:
            for group in groups(x, last):
                if said := judge(group):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*said, strict=True)], names=list(names))

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = {k: part.column(i).to_numpy(zero_copy_only=False) for i, k in enumerate(columns)}
                if held is not None:
                    x = {k: np.concatenate([held[k], x[k]]) for k in columns}
                yield from send(x, False)
        if held is not None:
            yield from send(held, True)
        give_back()

    dealt = rows.repartition("hub", "lo", "hi").sortWithinPartitions("hub", "lo", "hi")
    return dealt.mapInArrow(searched, f"{names[0]} long, {names[1]} long").distinct()


def possible(group: Group, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of a pair of blocks: rows, other rows, and which of their pairs are of different components and may be linked."""
    own, half = group["lo"][0] == group["hi"][0], WORDS // BITS
    first = np.arange(len(group["node"])) if own else np.flatnonzero(group["side"] == group["lo"][0])
    second = first if own else np.flatnonzero(group["side"] == group["hi"][0])
    for at in range(0, len(first), BLOCK):
        f = first[at : at + BLOCK]
        for to in range(at if own else 0, len(second), BLOCK):
            t = second[to : to + BLOCK]
            apart = np.zeros((len(f), len(t)), np.int32)
            for i in range(half):
                x = group[f"g{i}"][f][:, None] ^ group[f"g{i}"][t][None, :]
                x |= group[f"g{half + i}"][f][:, None] ^ group[f"g{half + i}"][t][None, :]
                apart += np.bitwise_count(x.view(np.uint64))  # of signed numbers it counts the absolute value's
            n_f, n_t = group["n"][f][:, None], group["n"][t][None, :]
            ok = (apart <= limit_unequal(limit)) & (group["component"][f][:, None] != group["component"][t][None, :])
            ok &= np.minimum(n_f, n_t) * 100 >= np.maximum(n_f, n_t) * limit
            yield f, t, np.triu(ok) if own and at == to else ok


def open_members(rows: DataFrame, limit: int) -> DataFrame:
    """hub, node of the members that may be linked with one of another component. rows: DEALT."""

    def judge(group: Group) -> list[tuple[int, int]]:
        found: set[int] = set()
        for f, t, ok in possible(group, limit):
            found.update(f[ok.any(axis=1)].tolist(), t[ok.any(axis=0)].tolist())
        return [(int(group["hub"][0]), int(group["node"][i])) for i in sorted(found)]

    return by_blocks(rows, judge, ("hub", "node"))


def search_blocks(rows: DataFrame, limit: int) -> DataFrame:
    """Links a, b between different components, of a hub's members in the same pair of blocks. rows: DEALT, shingles.

    Of the links found in a pair of blocks only those leave it that join components that earlier ones haven't joined, so
    a pair of blocks gives fewer links than it has members.
    """

    def judge(group: Group) -> list[tuple[int, int]]:
        sets = [np.frombuffer(x, np.uint64) for x in group["shingles"]]
        parent: dict[int, int] = {}

        def root(i: int) -> int:
            c = int(group["component"][i])
            while parent.setdefault(c, c) != c:
                c = parent[c]
            return c

        out: list[tuple[int, int]] = []
        for f, t, ok in possible(group, limit):
            for i in np.flatnonzero(ok.any(axis=1)):
                here = int(f[i])
                there = [int(j) for j in t[np.flatnonzero(ok[i])] if root(j) != root(here)]
                if not there:
                    continue
                both = overlaps(sets[here], [sets[j] for j in there])
                for j, common in zip(there, both.tolist(), strict=True):
                    x, y = root(here), root(j)
                    if x != y and 100 * common >= limit * (len(sets[here]) + len(sets[j]) - common):
                        parent[max(x, y)] = min(x, y)
                        out.append((int(group["node"][here]), int(group["node"][j])))
        return out

    return by_blocks(rows, judge, ("a", "b"))


def near_duplicates(docs: DataFrame, width: int = SHINGLE, limit: int = LIMIT) -> DataFrame:
    """Per row: doc_id, text_hash, n_shingles, component_id."""
    work = Workspace(docs.sparkSession, "minhash")
    sketch = work.table(sketches(docs, width), "sketches")
    usable = sketch.filter("n > 0 AND doc_id IS NOT NULL")
    least = usable.groupBy("print").agg(F.min(F.struct("doc_id", "n", "signature", "bands")).alias("s"), F.count(F.lit(1)).alias("copies"))
    reps = least.select("print", "copies", F.col("s.doc_id").alias("node"), "s.n", *(F.get("s.signature", F.lit(i)).alias(g) for i, g in enumerate(SIGNATURE)), "s.bands")
    reps = work.table(reps, "representatives")
    sketch_of = reps.select("node", "n", *SIGNATURE)

    keyed = reps.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    buckets = work.table(keyed.join(shared, "key"), "buckets")
    weight = buckets.groupBy("node").agg(F.sum("size").alias("weight"))
    hubs = buckets.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"))).alias("top"))
    hubs = hubs.select("key", (-F.col("top.minus")).alias("b"))
    stars = buckets.join(hubs, "key").filter("node <> b").select(F.col("node").alias("a"), "b").distinct()
    of_a = sketch_of.toDF("a", "n_a", *(f"a_{g}" for g in SIGNATURE))
    of_b = sketch_of.toDF("b", "n_b", *(f"b_{g}" for g in SIGNATURE))
    ok, apart = may_link([F.col(f"a_{g}") for g in SIGNATURE], F.col("n_a"), [F.col(f"b_{g}") for g in SIGNATURE], F.col("n_b"), limit)
    judged = stars.join(of_a, "a").join(of_b, "b").filter(ok)
    best = judged.groupBy("a").agg(F.min(F.struct(apart.alias("apart"), "b")).alias("s")).select("a", F.col("s.b").alias("b"))
    best = work.table(best, "stars")
    links = confirm(best, docs, width, limit, work, "stars")
    tied = work.table(components(links, work, "turn"), "components")

    #: Buckets with the same hub are searched as one, so a pair that shares many buckets is judged once.
    around = buckets.join(hubs, "key").select(F.col("b").alias("hub"), "node").distinct()
    named = around.join(tied, "node", "left").select("hub", "node", F.coalesce("component", "node").alias("component"))
    named = work.table(named, "named")
    left = work.table(open_members(deal(named, sketch_of, SKETCHED, work, "sketched"), limit), "open")
    full = full_sets(left.select(F.col("node").alias("doc_id")).distinct(), docs, width)
    open_rows = deal(named.join(left, ["hub", "node"]), sketch_of, BLOCK, work, "whole").join(full, "node").select(*DEALT, "shingles")
    more = work.table(search_blocks(open_rows, limit), "more")
    final = work.table(components(tied.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), work, "last"), "final")

    names = reps.join(final, "node", "left").select("print", F.coalesce("component", "node").alias("component"), "copies", "node").filter("copies > 1 OR component <> node").select("print", "component")
    return sketch.join(names, "print", "left").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, width: int = SHINGLE, limit: int = LIMIT) -> DataFrame:
    """Documents without those that are linked with a smaller id, and without repetitions of a row's id and text."""
    work = Workspace(docs.sparkSession, "keep-one")
    found = work.table(near_duplicates(docs, width, limit), "found")
    drop = found.filter("component_id IS NOT NULL AND doc_id <> component_id").select("doc_id", "text_hash").distinct()
    gone = sized(drop)
    same = (docs["doc_id"].cast("long") == gone["doc_id"]) & (F.xxhash64(docs["text"].cast("string")) == gone["text_hash"])
    kept = docs.join(gone, same, "left_anti")
    twice = found.filter("component_id IS NOT NULL AND doc_id = component_id").groupBy("doc_id", "text_hash").count().filter("count > 1")
    return kept if twice.isEmpty() else kept.dropDuplicates(["doc_id", "text"])


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir), width=4)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(list_slice(words, i, i + 3), ' ')))) END AS shingles FROM w
), p AS (
  SELECT doc_id, shingles, CAST(len(shingles) AS BIGINT) AS n, md5(array_to_string(shingles, chr(10))) AS print FROM s
), r AS (
  SELECT print, min(doc_id) AS node, any_value(n) AS n, any_value(shingles) AS shingles FROM p WHERE n > 0 GROUP BY print
), e AS (
  SELECT node, n, unnest(shingles) AS shingle FROM r
), l AS (
  SELECT a.node AS a, b.node AS b FROM e a JOIN e b ON a.shingle = b.shingle AND a.node <> b.node AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), t(a, b) AS (
  SELECT a, a FROM l UNION SELECT t.a, l.b FROM t JOIN l ON t.b = l.a
), c AS (
  SELECT a AS node, min(b) AS component FROM t GROUP BY a
)
SELECT p.doc_id, p.n AS n_shingles, coalesce(c.component, r.node, p.doc_id) AS component_id, coalesce(c.component, r.node, p.doc_id) = p.doc_id AS kept
FROM p LEFT JOIN r ON r.print = p.print AND p.n > 0 LEFT JOIN c ON c.node = r.node
"""
