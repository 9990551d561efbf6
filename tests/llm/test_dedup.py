import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainloom.llm import minhash_dedup as m
from chainloom.llm.common import Workspace
from tests.llm import brute


def result(df, **options):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in m.near_duplicates(df, **options).collect()}


def corpus(seed=3):
    """A base with mutated copies and copies of those, exact copies, and unrelated texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, n = [], 0
    for _ in range(12):
        base = [word() for _ in range(rng.randint(3, 90))]
        family = [base]
        for _ in range(rng.randint(0, 14)):
            w = list(rng.choice(family))
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = word()
            family.append(w)
        for w in family:
            rows.append((n, " ".join(w)))
            n += 1
    rng.shuffle(rows)
    return rows


def test_components_equal_brute_force(docs):
    rows = corpus()
    assert result(docs(*rows), width=5) == brute.components(rows, 5)


def test_group_without_a_hub(docs):
    """A chain: neighbours are linked, others aren't, so no hub has them all."""
    words = [f"w{i}" for i in range(140)]
    rows = [(k, " ".join(words[8 * k : 8 * k + 80])) for k in range(8)]
    got = result(docs(*rows), width=4)
    assert got == brute.components(rows, 4)
    assert got[7][1] == 0


def test_blocks_of_a_large_bucket(docs, monkeypatch):
    """Blocks and replicas of a few rows, and joins instead of broadcasts."""
    monkeypatch.setattr(m, "BLOCK", 8)
    monkeypatch.setattr(m, "SKETCHED", 16)
    monkeypatch.setattr(m, "MEMBERS", 2)
    monkeypatch.setattr(m, "BROADCAST_IDS", 0)
    rows = corpus(5)
    assert result(docs(*rows), width=4) == brute.components(rows, 4)


def windows(seed, docs=240, words=90):
    """Overlapping windows of a few long sequences, with strays between them: only the search of blocks finds all links."""
    rng = random.Random(seed)
    rows, n = [], 0
    for k in range(3):
        line, at = [f"v{k}w{i}" for i in range(words + 8 * docs)], 0
        for _ in range(docs // 3):
            text = line[at : at + words]
            at += rng.randint(5, 9)
            if rng.random() < 0.2:
                text = [*text[: words // 2], *(f"z{n}y{j}" for j in range(words // 2))]
            rows.append((n, " ".join(text)))
            n += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("block", "sketched"), [(256, 2048), (8, 8)])
def test_chains_of_windows(docs, monkeypatch, block, sketched):
    monkeypatch.setattr(m, "BLOCK", block)
    monkeypatch.setattr(m, "SKETCHED", sketched)
    rows = windows(block)
    assert result(docs(*rows), width=4) == brute.components(rows, 4)


def test_no_pair_at_the_limit_is_estimated_out():
    """Signatures of pairs at and above the limit stay within the margin, whatever their top bits."""
    rng = np.random.default_rng(5)
    for share in (0.8, 0.85, 0.9, 0.95):
        both = round(400 * 2 * share / (1 + share))
        for _ in range(100):
            x = rng.integers(0, 1 << 64, 800 - both, np.uint64)
            a, b = m.packed(m.minima(x[:400])), m.packed(m.minima(x[-400:]))
            group = {f"g{i}": np.array([a[i], b[i]]) for i in range(m.WORDS)}
            group |= {k: np.array(v) for k, v in {"lo": [0, 0], "hi": [0, 0], "side": [0, 0], "node": [0, 1], "component": [0, 1], "n": [400, 400]}.items()}
            assert any(ok.any() for _, _, ok in m.possible(group, 80))


def test_odd_rows(odd, spark):
    out = m.near_duplicates(odd, width=4).collect()
    assert len(out) == 10
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in out}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (7, 1, 4), (8, 1, 8)} <= got
    assert [r.component_id for r in out if r.doc_id is None] == [None]
    assert m.near_duplicates(odd.limit(0), width=4).count() == 0


def test_one_of_each_group_stays(docs, odd):
    rows = [(3, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "other text of five words"), (None, "a b c d e f")]
    kept = m.keep_one(docs(*rows))
    assert kept.columns == docs(*rows).columns
    assert sorted((r.doc_id or 0, r.component_id) for r in kept.collect()) == [(0, "clash"), (1, "clash"), (2, "clash")]
    assert m.keep_one(odd).count() == 8


def test_limit_is_inclusive(docs):
    """Nine and eight of nine shingles, 8 / 10 of them common."""
    a = [f"w{i}" for i in range(12)]
    b = [*a[:11], "x"]
    both = len(brute.shingles(" ".join(a), 4) & brute.shingles(" ".join(b), 4))
    assert both == 8
    rows = [(0, " ".join(a)), (1, " ".join(b))]
    assert result(docs(*rows), width=4) == brute.components(rows, 4) == {0: (9, 0), 1: (9, 0)}


def test_estimates_are_corrected_for_collisions():
    rng = np.random.default_rng(1)
    errors = []
    for share in (0.2, 0.5, 0.8, 0.95):
        common = rng.integers(0, 1 << 63, int(1000 * share)).astype(np.uint64)
        a, b = (np.concatenate([common, rng.integers(0, 1 << 63, 1000 - len(common)).astype(np.uint64)]) for _ in range(2))
        x, y = (m.packed(m.minima(s)) for s in (a, b))
        half = m.WORDS // m.BITS
        apart = sum(int(np.bitwise_count(((x[i] ^ y[i]) | (x[half + i] ^ y[half + i])).view(np.uint64))) for i in range(half))
        errors.append(1 - apart / m.PERMUTATIONS / (1 - 2.0**-m.BITS) - len(common) / (2000 - len(common)))
    assert max(map(abs, errors)) < 0.21


def test_components_of_a_long_chain(spark):
    from chainloom.llm.common import Workspace

    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    out = {r.node: r.component for r in m.components(edges, Workspace(spark, "t"), "t").collect()}
    assert out == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}
    none = m.components(edges.filter(F.lit(False)), Workspace(spark, "t"), "t")
    assert none.count() == 0


def test_written_tables_are_plain_and_verified(spark):
    """nothing but data is written between steps, as each file starts a program; a changed byte is still an error."""
    work = Workspace(spark, "plain")
    table = work.table(spark.range(50_000).selectExpr("id", "CAST(id AS string) AS s"), "t")
    assert tuple(table.selectExpr("count(*)", "sum(id)").first()) == (50_000, 50_000 * 49_999 // 2)
    folder = Path(work.path("t").removeprefix("file://"))
    assert {p.name.split("-")[0] for p in folder.iterdir()} == {"part"}
    part = next(folder.iterdir())
    data = bytearray(part.read_bytes())
    data[len(data) // 3] ^= 1
    part.write_bytes(data)
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        table.selectExpr("sum(id)", "max(s)").collect()


@pytest.mark.parametrize(
    ("edges", "turns"),
    [([], 0), ([(2, 1), (3, 1), (4, 4), (9, 7)], 0), ([(1, 2), (1, 2), (3, 1)], 0), ([(3, 1), (3, 2)], 1), ([(i, i + 1) for i in range(40)] + [(90, 95), (95, 93)], None)],
)
def test_component_search_ends_at_stars(spark, edges, turns):
    """no turn is made and written only to see that it changes nothing."""
    written = []

    class Counted(Workspace):
        def table(self, df, name):
            written.append(name)
            return super().table(df, name)

    found = m.components(spark.createDataFrame(edges, "a long, b long"), Counted(spark, "stars"), "turn").collect()
    group = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in group:
        for a, b in edges:
            if a != b:
                group[a] = group[b] = min(group[a], group[b])
    assert sorted(map(tuple, found)) == sorted(group.items())
    assert turns is None or len(written) == turns
