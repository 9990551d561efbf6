"""Masking of token arrays for evaluation: by rule, and by reproducible chance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORED = -100  # label of a position that isn't masked

#: One rule: the features of a row it is for, in order, what to do, and with which numbers.
RULES = "array<struct<if_combo_feats:array<string>,action:string,params:struct<num_tokens:int,start_index:int,end_index:int>>>"


def rules_column(path_or_json: str, is_path: bool = False) -> Column:
    """The masking_rules of a JSON document as a literal column."""
    if is_path:
        with open(path_or_json) as f:
            path_or_json = f.read()
    return F.from_json(F.lit(path_or_json), f"masking_rules {RULES}")["masking_rules"]


def first_rule(rules: Column, feats: Column) -> Column:
    """The first rule for a row's features in order; null if there is none. Rules that aren't sorted never match."""
    return F.get(F.filter(rules, lambda r: r["if_combo_feats"] == F.array_sort(feats)), F.lit(0))


def span(rule: Column, size: Column) -> tuple[Column, Column]:
    """Start and end of what a rule masks in a row of so many tokens."""
    action, params = rule["action"], rule["params"]
    middle = F.call_function("div", size, F.lit(2)) - F.call_function("div", params["num_tokens"], F.lit(2))
    start = F.when(action == "mask_middle", middle).when(action == "mask_slice", params["start_index"].cast("long")).otherwise(F.lit(0))
    end = F.when(action == "mask_middle", middle + params["num_tokens"]).when(action == "mask_slice", params["end_index"].cast("long")).otherwise(size)
    return start.cast("int"), end.cast("int")


def by_rule(ids: Column, rule: Column, mask: int) -> tuple[Column, Column]:
    """(masked ids, labels): a span out of range, or no rule, leaves the row as it is."""
    size = F.size(ids)
    start, end = span(rule, size)
    fits = F.coalesce(rule.isNotNull() & (start >= 0) & (start < end) & (end <= size), F.lit(False))
    inside = lambda i: fits & (i >= start) & (i < end)
    return F.transform(ids, lambda t, i: F.when(inside(i), F.lit(mask)).otherwise(t)), F.transform(ids, lambda t, i: F.when(inside(i), t).otherwise(F.lit(IGNORED)))


def chosen(ids: Column, key: Column, share: float, specials: list[int], seed: int = 42) -> Column:
    """Positions (from 0) of a reproducible choice: max(1, half-even round of the share) of those without specials."""
    places = F.transform(ids, lambda t, i: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), i.cast("string"))).alias("h"), i.alias("i"), t.isin(specials).alias("special")))
    free = F.array_sort(F.filter(places, lambda p: ~p["special"]))
    n = F.greatest(F.lit(1), F.bround(F.size(free) * F.lit(share)).cast("int"))
    return F.transform(F.slice(free, F.lit(1), n), lambda p: p["i"])


def placed(ids: Column, at: Column, change: Callable[[Column, Column], Column]) -> tuple[Column, Column]:
    """(ids changed at the given positions, labels). at is bound once: inside the element's function it would be made anew
    for every element."""
    rows = F.transform(
        F.array(F.struct(ids.alias("ids"), at.alias("at"))),
        lambda s: F.struct(
            F.transform(s["ids"], lambda t, i: F.when(F.array_contains(s["at"], i), change(t, i)).otherwise(t)).alias("ids"),
            F.transform(s["ids"], lambda t, i: F.when(F.array_contains(s["at"], i), t).otherwise(F.lit(IGNORED))).alias("labels"),
        ),
    )
    return F.get(rows, F.lit(0))["ids"], F.get(rows, F.lit(0))["labels"]


def at_random(ids: Column, key: Column, share: float, mask: int, specials: list[int], seed: int = 42) -> tuple[Column, Column]:
    """(masked ids, labels) with the chosen positions masked."""
    return placed(ids, chosen(ids, key, share, specials, seed), lambda t, i: F.lit(mask))


def dynamic(ids: Column, key: Column, share: float, mask: int, vocab_size: int, specials: list[int], seed: int = 42) -> tuple[Column, Column]:
    """(ids, labels): of the chosen positions 80 % are masked, 10 % get another id, 10 % stay, each by a hash."""

    def changed(t: Column, i: Column) -> Column:
        h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"d{seed}"), key.cast("string"), i.cast("string"))), 1, 8), 16, 10).cast("long")
        return F.when(h % 10 < 8, F.lit(mask)).when(h % 10 == 8, (F.call_function("div", h, F.lit(10)) % vocab_size).cast("int")).otherwise(t)

    return placed(ids, chosen(ids, key, share, specials, seed), changed)


def restored(ids: Column, labels: Column, pad: int) -> Column:
    """The original ids without padding."""
    return F.filter(F.zip_with(ids, labels, lambda t, y: F.when(y != IGNORED, y).otherwise(t)), lambda t: t != pad)


def filled(ids: Column, labels: Column, preds: Column, pad: int) -> Column:
    """The masked ids with predictions in the masked places, without padding."""
    three = F.arrays_zip(ids.alias("t"), labels.alias("y"), preds.alias("p"))
    return F.filter(F.transform(three, lambda r: F.when(r["y"] != IGNORED, r["p"]).otherwise(r["t"])), lambda t: t != pad)
