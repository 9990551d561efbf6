"""From a table of features to a corpus: subsets, tags, splits, shards and samples."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainloom.functions.exprs import first_peptide, has_feature, is_protein, spaced
from chainloom.functions.schema import FEATURES, or_blank
from chainloom.sources.scratch import scratch

#: How a model's corpus joins values, and which models get characters with blanks between.
SEPARATORS = {"bert": " [SEP] ", "protbert": " [SEP] ", "esm": " ", "llama": " "}
SPACED = {"protbert"}
SKIPPED = {("peptide",)}  # subsets that are left out

#: Boundary tokens of each feature.
TAGS = {"tra": ("[TRA]", "[ETRA]"), "trb": ("[TRB]", "[ETRB]"), "peptide": ("[PEP]", "[EPEP]"), "mhc_one": ("[MHO]", "[EMHO]"), "mhc_two": ("[MHT]", "[EMHT]")}


def subsets(names: list[str], skipped: set[tuple[str, ...]] = SKIPPED) -> list[tuple[str, ...]]:
    """All non-empty subsets, by size and then in the names' order."""
    return [c for n in range(1, len(names) + 1) for c in combinations(names, n) if c not in skipped]


def power_set(df: DataFrame, model: str = "bert", features: list[str] | None = None, keep: list[str] | None = None, skipped: set[tuple[str, ...]] = SKIPPED) -> DataFrame:
    """A row for each subset of a row's features that are all there: keep, combo_id, combo_feats.

    The subsets are static, so a row's list is built in place from the features' values and no row is made only to be
    filtered away; features are projected first, so the scan reads nothing else.
    """
    features = features or FEATURES
    values = {f: F.col(f) for f in features}
    said = {f: F.when(v.contains("+"), first_peptide(v, strip=True)).otherwise(v) for f, v in values.items()}
    if model in SPACED:
        said = {f: spaced(v) for f, v in said.items()}

    def one(names: tuple[str, ...]) -> Column:
        there = has_feature(values[names[0]])
        for n in names[1:]:
            there = there & has_feature(values[n])
        return F.when(there, F.struct(F.concat_ws(SEPARATORS[model], *(said[n] for n in names)).alias("combo_id"), F.array(*map(F.lit, names)).alias("combo_feats")))

    rows = df.select(*(keep or []), *(or_blank(df, f) for f in features))
    listed = F.filter(F.array(*(one(s) for s in subsets(features, skipped))), lambda c: c.isNotNull())
    return rows.select(*(keep or []), F.explode(listed).alias("c")).select(*(keep or []), "c.combo_id", "c.combo_feats")


def subset_counts(df: DataFrame, features: list[str] | None = None, skipped: set[tuple[str, ...]] = SKIPPED, by: list[str] | None = None) -> DataFrame:
    """combo, n: how many rows have all features of a subset, the most frequent first; as counting a power set's rows.

    Rows are counted by which features they have, and only those few counts are multiplied by subsets.
    """
    features, by = features or FEATURES, by or []
    there = [has_feature(or_blank(df, f)).alias(f"_{i}") for i, f in enumerate(features)]
    counted = df.select(*by, *there).groupBy(*by, *(f"_{i}" for i in range(len(features)))).agg(F.count(F.lit(1)).alias("_n"))
    has = {f: F.coalesce(F.col(f"_{i}"), F.lit(False)) for i, f in enumerate(features)}
    listed = F.array(*(F.when(reduce(lambda a, b: a & b, (has[f] for f in s)), F.lit("_".join(sorted(s)))) for s in subsets(features, skipped)))
    each = counted.select(*by, "_n", F.explode(F.filter(listed, lambda c: c.isNotNull())).alias("combo"))
    return each.groupBy(*by, "combo").agg(F.sum("_n").alias("n")).orderBy(*by, F.desc("n"), "combo")


def tagged(df: DataFrame, tags: dict[str, tuple[str, str]] = TAGS) -> Column:
    """array<string> of "[TRA] C A S [ETRA]" for each feature that is a protein."""
    each = []
    for name, (begin, end) in tags.items():
        c = or_blank(df, name)
        each.append(F.when(is_protein(c), F.concat_ws(" ", F.lit(begin), spaced(c), F.lit(end))))
    return F.filter(F.array(*each), lambda t: t.isNotNull())


def order_key(key: Column, seed: int) -> Column:
    """A reproducible shuffle's sort key: the same in every engine with MD5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_split(df: DataFrame, key: str, seed: int = 42, val: float = 0.1, test: float = 0.1) -> DataFrame:
    """Adds split by a hash of the key alone: no shuffle, shares approximate, the same for a key wherever it occurs."""
    place = F.conv(F.substring(order_key(F.col(key), seed), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    return df.withColumn("split", F.when(place < test, "test").when(place < test + val, "val").otherwise("train"))


def exact_split(df: DataFrame, key: str, seed: int = 42, val: float = 0.1, test: float = 0.1) -> DataFrame:
    """Adds split with exact sizes: the first shares of the rows in the order of a hash of the key.

    Ranks come in two steps, so no task gathers all rows: rows are numbered within 4096 ranges of the hash, and the
    ranges' sizes are summed up in a table of as many rows.
    """
    ranked = ranked_by(df, order_key(F.col(key), seed), key)
    n = F.col("_n")
    n_test, n_val = F.round(n * test), F.round(n * val)
    split = F.when(F.col("_rank") <= n_test, "test").when(F.col("_rank") <= n_test + n_val, "val").otherwise("train")
    return ranked.withColumn("split", split).drop("_rank", "_n")


def ranked_by(df: DataFrame, hexes: Column, tie: str) -> DataFrame:
    """Adds _rank (from 1) in the order of a hexadecimal key, and _n, the number of rows."""
    coded = df.withColumn("_hex", hexes).withColumn("_range", F.substring("_hex", 1, 3))
    sizes = coded.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("_range").alias("_r"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"), F.sum("_size").over(every).alias("_n"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("_hex", tie))
    numbered = coded.withColumn("_inside", inside).join(F.broadcast(sizes), F.col("_range") == F.col("_r"))  # 4096 rows
    return numbered.withColumn("_rank", F.col("_inside") + F.col("_before")).drop("_hex", "_range", "_r", "_inside", "_before")


def ranked(df: DataFrame, key: str) -> DataFrame:
    """Adds _rank, from 0 in the key's order, and _n, the number of rows.

    Rows are numbered within ranges of the key and ranges' sizes are summed up, so no task sorts them all. The ranges are
    written to the shared folder, as both their sizes and their rows are read.
    """
    at = f"{scratch(df.sparkSession, 'ranked')}/ranges"
    df.repartitionByRange(F.col(key)).withColumn("_part", F.spark_partition_id()).write.parquet(at)
    spread = df.sparkSession.read.parquet(at)
    sizes = spread.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sizes = sizes.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"), F.sum("_size").over(every).alias("_n"))
    numbered = spread.withColumn("_inside", F.row_number().over(Window.partitionBy("_part").orderBy(key)))
    numbered = numbered.join(F.broadcast(sizes), F.col("_part") == F.col("_p"))  # a row for each partition
    return numbered.withColumn("_rank", F.col("_inside") + F.col("_before") - 1).drop("_part", "_inside", "_p", "_before")


def contiguous_shards(df: DataFrame, key: str, shards: int) -> DataFrame:
    """Adds shard: runs of equal length in the key's order, the last one with the remainder."""
    chunk = F.greatest(F.floor(F.col("_n") / F.lit(shards)), F.lit(1))
    return ranked(df, key).withColumn("shard", F.least(F.floor(F.col("_rank") / chunk), F.lit(shards - 1)).cast("int")).drop("_rank", "_n")


def rank_batches(df: DataFrame, key: str, ranks: int, batch: int, drop_last: bool = True) -> DataFrame:
    """Adds place, rank and batch: rows in the key's order are dealt to ranks in turn, and batched within a rank.

    With drop_last only rows stay that give every rank the same number of full batches.
    """
    rows = ranked(df, key).withColumn("place", F.col("_rank").cast("long"))
    rows = rows.withColumn("rank", F.pmod("place", F.lit(ranks))).withColumn("batch", F.floor(F.col("place") / (ranks * batch)))
    if drop_last:
        rows = rows.filter(F.col("batch") < F.floor(F.col("_n") / (ranks * batch)))
    return rows.drop("_rank", "_n")


def take_shuffled(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of a reproducible shuffle: a top-k, not a sort."""
    return df.orderBy(order_key(F.col(key), seed), key).limit(n)


def sampled(df: DataFrame, share: float = 0.1, seed: int = 21) -> DataFrame:
    """A sampling operator for smoke runs: about a share of the rows."""
    return df.sample(False, share, seed)


def by_length(df: DataFrame, ids: str = "input_ids", within: bool = False) -> DataFrame:
    """Rows by number of tokens: over all, or within partitions, which batches of like lengths need no more than."""
    return df.sortWithinPartitions(F.size(ids)) if within else df.orderBy(F.size(ids))
