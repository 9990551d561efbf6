import numpy as np
import pytest
from pyspark.sql import functions as F

from chainloom.llm import class_lm as lm
from tests.llm import brute


def scored(df, held):
    mask = F.coalesce(held, F.lit(False))
    return lm.score(df, ~mask, mask).collect()


def texts(n=60):
    rng = np.random.default_rng(0)
    nouns, verbs = [f"n{i}" for i in range(30)], [f"v{i}" for i in range(30)]
    return [(i, " ".join(w for _ in range(rng.integers(1, 20)) for w in (rng.choice(nouns), rng.choice(verbs)))) for i in range(n)]


@pytest.mark.parametrize("table", [lm.TABLE, 8])
def test_counts_and_base_score(docs, monkeypatch, table):
    """With a table of eight words nearly all counts come by the join."""
    monkeypatch.setattr(lm, "TABLE", table)
    rows = [*texts(), (100, None), (101, ""), (102, "Never SEEN before"), (103, "n1 N1\tn1")]
    held = F.col("doc_id") % 7 == 2
    got = {r.doc_id: r for r in scored(docs(*rows), held)}
    for d, (n, known, total, base) in brute.unigram(rows, lambda d: d % 7 == 2).items():
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, d % 7 == 2)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0


def test_score_by_hand(docs, spark):
    """The formula, from the model's own classes and plain counts."""
    rows = texts(30)
    df = docs(*rows)
    from chainloom.llm.common import Workspace

    model, counts, n, v = lm.train(df.select("text"), Workspace(spark, "t"))
    got = {r.doc_id: r.score for r in scored(df, F.lit(False))}
    c = {r.hash: r.n for r in counts.collect()}
    assert (n, v) == (sum(c.values()), len(c))
    for d, t in rows[:5]:
        total, before = 0.0, model.of[lm.EDGE]
        h = np.array([lm.word_hash(w) for w in t.encode().lower().split()], np.uint64)
        for x, i in zip(h, model.of[model.table.items(h, lm.group_of(h))], strict=True):
            total += model.step[before, i] + np.log10(c[int(x.view(np.int64))] + 1) - model.among[i]
            before = i
        assert got[d] == pytest.approx(total + model.step[before, model.of[lm.EDGE]], rel=1e-9)


def test_probabilities_add_up(docs, spark):
    from chainloom.llm.common import Workspace

    model, counts, _, _ = lm.train(docs(*texts()).select("text"), Workspace(spark, "t"))
    assert (10**model.step).sum(axis=1) == pytest.approx(np.ones(lm.CLASSES))
    rows = counts.filter("grp >= 0").collect()
    h, g = np.array([r.hash for r in rows]).view(np.uint64), np.array([r.grp for r in rows])
    mass = np.zeros(lm.CLASSES)
    np.add.at(mass, model.of[model.table.items(h, g)], [(r.n + 1) for r in rows])
    full = np.unique(model.of[model.table.items(h, g)])
    assert (mass[full] / 10 ** model.among[full] < 1).all()
    assert (mass[full] / 10 ** model.among[full] > 0.5).all()


def test_exchange_raises_the_likelihood_and_finds_classes():
    items = lm.ITEMS
    b = np.zeros((items, items))
    rng = np.random.default_rng(1)
    left, right = rng.integers(0, 20, 4000), rng.integers(20, 40, 4000)
    np.add.at(b, (left, right), 1)
    np.add.at(b, (right[:-1], left[1:]), 1)
    of = lm.exchange(b, 4)
    start = np.zeros(items, int)
    order = np.argsort(-b.sum(axis=1), kind="stable")
    start[order[order != lm.EDGE]] = 1 + np.arange(items - 1) % 3

    def likelihood(of):
        one = np.eye(4)[of]
        m = one.T @ b @ one
        return lm.xlogx(m).sum() - lm.xlogx(m.sum(axis=0)).sum() - lm.xlogx(m.sum(axis=1)).sum()

    assert likelihood(of) > likelihood(start)
    assert not set(of[:20]) & set(of[20:40])


def test_classes_beat_unigrams_on_held_out_texts(docs):
    out = [r for r in scored(docs(*texts(200)), F.col("doc_id") % 7 == 2) if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_odd_rows(odd, docs):
    out = scored(odd, F.col("doc_id") % 7 == 2)
    assert len(out) == 10
    assert {(r.n_tokens, r.n_known) for r in out if r.doc_id in (1, 2, 3)} == {(1, 1)}
    assert [r.held_out for r in out if r.doc_id is None] == [False]
    assert scored(odd.limit(0), F.lit(False)) == []
    alone = scored(docs((2, "a b")), F.lit(True))
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in alone] == [(3, 0, 0, 0.0)]


@pytest.mark.parametrize("table", [lm.TABLE, 700])
def test_rare_words_choose_their_own_class(docs, spark, monkeypatch, table):
    """Words beyond the most frequent ones, in the table or joined, go by their neighbours and not by their last bytes."""
    monkeypatch.setattr(lm, "TABLE", table)
    rng = np.random.default_rng(3)
    pick = lambda kind: f"{kind}{int(900 * rng.random() ** 1.5)}"
    rows = [(i, " ".join(w for _ in range(20) for w in (pick("n"), pick("v")))) for i in range(600)] + [(600, "new1 new2 n1")]
    df = docs(*rows)
    from chainloom.llm.common import Workspace

    model, counts, _, _ = lm.train(df.filter("doc_id < 600").select("text"), Workspace(spark, "t"))
    rarer = {r.hash: r.cls for r in model.rarer.collect()}
    assert bool(rarer) == (table == 700)
    kinds = {}
    count = {r.hash: r.n for r in counts.collect()}
    of = {}
    for word in {w for _, t in rows for w in t.split()}:
        h = np.array([lm.word_hash(word.encode())], np.uint64)
        key = int(h.view(np.int64)[0])
        item = model.table.items(h, lm.group_of(h))[0]
        of[word] = (rarer.get(key, model.of[item]), count.get(key, 0))
        if key in count and item >= lm.FREQUENT:
            kinds.setdefault(of[word][0], []).append(word[0])
    assert sum(map(len, kinds.values())) == len(count) - 1 - lm.FREQUENT
    assert sum(max(v.count("n"), v.count("v")) for v in kinds.values()) > 0.97 * sum(map(len, kinds.values()))
    got = {r.doc_id: r.score for r in scored(df, F.col("doc_id") == 600)}
    for d, t in [*rows[:20], rows[600]]:
        total, before = 0.0, model.of[lm.EDGE]
        for c, n in map(of.get, t.split()):
            total += model.step[before, c] + np.log10(n + 1) - model.among[c]
            before = c
        assert got[d] == pytest.approx(total + model.step[before, model.of[lm.EDGE]], rel=1e-9)


@pytest.mark.parametrize("piece", [lm.PIECE, 1 << 10])
def test_words_of_texts(monkeypatch, piece):
    """Words are runs outside space and 0x09 to 0x0D, whatever Unicode holds for white space; long texts are cut between them."""
    import pyarrow as pa

    monkeypatch.setattr(lm, "PIECE", piece)
    texts = ["A b\xa0C\u2003d \x1ce\x85", None, "", "  \t\n\x0b\x0c\r", "x " * 3000 + "\xc9t\xe9 \u0130", " B"]
    got = lm.words_of(pa.array(texts))
    h, sizes = got.once[got.code], got.sizes
    words = [(t or "").encode().lower().split() for t in texts]
    assert sizes.tolist() == [len(w) for w in words]
    assert h.tolist() == [lm.word_hash(x) for w in words for x in w]
    part = pa.array(texts).slice(3, 2)
    assert lm.words_of(part).sizes.tolist() == [len(w) for w in words[3:5]]


def test_classes_grow_with_the_vocabulary(spark, docs):
    from chainloom.llm.common import Workspace

    model, *_ = lm.train(docs((1, " ".join(f"w{i}" for i in range(64_000)))).select("text"), Workspace(spark, "t"))
    assert len(model.step) == 40 > lm.CLASSES
