import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chainloom.operators import corpus, masking, metrics, pairing, stats, tokens


def one(spark, df_row, schema, *columns):
    row = spark.createDataFrame([df_row], schema).select(*(c.alias(f"o{i}") for i, c in enumerate(columns))).first()
    return row[0] if len(columns) == 1 else tuple(row)


def features(spark, *rows):
    return spark.createDataFrame(list(rows), "tra string, trb string, peptide string, mhc_one string, mhc_two string")


def test_power_set_of_present_features(spark):
    out = corpus.power_set(features(spark, ("CA", "NA", "GIL+X", "", None))).collect()
    assert [(r.combo_id, r.combo_feats) for r in out] == [("CA", ["tra"]), ("CA [SEP] GIL", ["tra", "peptide"])]
    assert corpus.power_set(features(spark, ("CA", None, "G", None, None)), "protbert").collect()[1].combo_id == "C A [SEP] G"
    assert corpus.power_set(features(spark, ("CA", "CB", "GIL", "M", "N"))).count() == 30
    assert corpus.power_set(features(spark, ("", "", "GIL", "", ""))).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.sampled_from(["", "NA", None, "CA"]), min_size=5, max_size=5))
def test_power_set_size(spark, values):
    n = sum(v == "CA" for v in values)
    assert corpus.power_set(features(spark, tuple(values))).count() == 2**n - 1 - (values[2] == "CA")


def test_tags(spark):
    df = features(spark, ("CA", "CB", "GIL", "", None))
    assert df.select(corpus.tagged(df)).first()[0] == ["[TRA] C A [ETRA]", "[PEP] G I L [EPEP]"]


def test_splits_are_exact_disjoint_and_exhaustive(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    got = {r.split: r.n for r in corpus.exact_split(df, "k").groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert got == {"train": 800, "val": 100, "test": 100}
    assert corpus.exact_split(df, "k").select("k").distinct().count() == 1000
    assert corpus.hash_split(df, "k").filter("split = 'test'").count() in range(60, 140)


def test_shards_take_the_remainder_last(spark):
    out = corpus.contiguous_shards(spark.range(11).withColumnRenamed("id", "k"), "k", 3)
    assert [(r.shard, r.k) for r in out.orderBy("k").collect()] == [(min(k // 3, 2), k) for k in range(11)]


def test_sort_by_length(spark):
    df = spark.createDataFrame([([1, 2],), ([1],), ([],)], "input_ids array<int>")
    assert [len(r[0]) for r in corpus.by_length(df).collect()] == [0, 1, 2]
    assert corpus.by_length(df, within=True).count() == 3


IDS = "ids array<int>"


def test_shift(spark):
    assert one(spark, ([1, 2, 3, 4, 5, 6],), IDS, *tokens.shifted(F.col("ids"), 4)) == ([1, 2, 3, 0], [2, 3, 4, 0])
    assert one(spark, ([1, 2, 3, 4, 5, 6],), IDS, *tokens.shifted(F.col("ids"), 4, truncate=False)) == ([1, 2, 3, 4], [2, 3, 4, 5])
    assert one(spark, ([1, 2],), IDS, *tokens.shifted(F.col("ids"), 4)) == ([1, 2, 0, 0], [2, 0, 0, 0])


def test_windows(spark):
    got = one(spark, ([1, 2, 3, 4, 5, 6],), IDS, tokens.windows(F.col("ids"), 3))
    assert [(w.x, w.y) for w in got] == [([1, 2, 3], [2, 3, 4]), ([2, 3, 4], [3, 4, 5]), ([3, 4, 5], [4, 5, 6])]
    got = one(spark, ([1, 2],), IDS, tokens.windows(F.col("ids"), 3))
    assert [(w.x, w.y) for w in got] == [([1, 2, 0], [2, 0, 0])]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(1, 9), max_size=12), st.integers(1, 5))
def test_padded_length_is_constant(spark, ids, n):
    got = one(spark, (ids,), IDS, tokens.padded(F.col("ids"), n))
    assert got == (ids + [0] * n)[:n]


def test_vocabulary_round_trip(spark):
    df = spark.createDataFrame([("C A S",), ("C A",)], "t string")
    vocab = tokens.vocabulary(df, F.col("t"), 15)
    assert list(vocab)[13:] == ["A", "C"]
    words = tokens.vocabulary_map(vocab)
    ids = tokens.encode(F.col("t"), words, vocab[tokens.UNK])
    assert [tuple(r) for r in df.select(ids, tokens.decode(ids, tokens.inverted(words))).collect()] == [([14, 13, 1], "C A [UNK]"), ([14, 13], "C A")]


def test_merges(spark):
    df = spark.createDataFrame([("abab abc",), ("ab ab",)], "t string")
    counts = tokens.word_counts(df, F.col("t"))
    merges = tokens.bpe_merges(counts, 2)
    assert merges[0] == ("a", "b")
    vocab = tokens.bpe_vocabulary(counts, merges)
    ids = df.select(tokens.bpe_encoder(merges, vocab)(F.col("t"))).first()[0]
    assert "".join({i: w for w, i in vocab.items()}[i] for i in ids) == "abababc"


def test_spaced_residues_never_merge(spark):
    df = spark.createDataFrame([("[TRA] C A S S [ETRA]",)], "t string")
    assert tokens.bpe_merges(tokens.word_counts(df, F.col("t")), 10) == []


def test_subword_file(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    tok = tokenizers.Tokenizer(tokenizers.models.WordLevel({"[UNK]": 0, "C": 1, "A": 2}, "[UNK]"))
    tok.pre_tokenizer = tokenizers.pre_tokenizers.WhitespaceSplit()
    tok.save(str(tmp_path / "t.json"))
    df = spark.createDataFrame([("C A x A",), (None,)], "t string")
    assert [r[0] for r in df.select(tokens.subword_encoder(str(tmp_path / "t.json"), 3)(F.col("t"))).collect()] == [[1, 2, 0], []]


def test_batch_padding(spark):
    df = spark.createDataFrame([(1, [5]), (1, [5, 6]), (2, [7])], "b int, input_ids array<int>")
    got = sorted((r.b, r.input_ids, r.attention_mask) for r in tokens.batch_padded(df, "b").collect())
    assert got == [(1, [5, 0], [1, 0]), (1, [5, 6], [1, 1]), (2, [7], [1])]


RULES = '{"masking_rules": [{"if_combo_feats": ["trb", "tra"], "action": "mask_all", "params": {}}, {"if_combo_feats": ["tra"], "action": "mask_middle", "params": {"num_tokens": 3}}, {"if_combo_feats": ["trb"], "action": "mask_slice", "params": {"start_index": 5, "end_index": 9}}, {"if_combo_feats": ["peptide"], "action": "else", "params": {}}]}'


@pytest.mark.parametrize(
    ("feats", "expected"),
    [(["tra"], [1, 2, 0, 0, 0, 6, 7]), (["trb"], [1, 2, 3, 4, 5, 6, 7]), (["peptide"], [0] * 7), (["tra", "trb"], [1, 2, 3, 4, 5, 6, 7])],
)
def test_rules(spark, feats, expected):
    df = spark.createDataFrame([(list(range(1, 8)), feats)], "ids array<int>, f array<string>").withColumn("rule", masking.first_rule(masking.rules_column(RULES), F.col("f")))
    ids, labels = masking.by_rule(F.col("ids"), F.col("rule"), 0)
    masked, kept, back = df.select(ids, labels, masking.restored(ids, labels, 99)).first()
    assert masked == expected
    assert back == list(range(1, 8))
    assert all((y == masking.IGNORED) == (t != 0) for t, y in zip(masked, kept, strict=True))


def test_random_masking_leaves_specials(spark):
    df = spark.createDataFrame([(1, [9, 5, 6, 7, 8, 9]), (2, [5])], "k int, ids array<int>")
    rows = df.select(*masking.at_random(F.col("ids"), F.col("k"), 0.4, 0, [9])).collect()
    assert [sum(t == 0 for t in r[0]) for r in rows] == [2, 1]
    assert all(r[0][0] in (9, 0) and 9 not in [y for y in r[1] if y != -100] for r in rows)
    ids, labels = df.select(*masking.dynamic(F.col("ids"), F.col("k"), 0.4, 0, 10, [9])).first()
    assert all(y in (-100, t0) for y, t0 in zip(labels, [9, 5, 6, 7, 8, 9], strict=True))


def judged(spark, *rows):
    return spark.createDataFrame(list(rows), "labels array<int>, preds array<int>")


def test_accuracies(spark):
    df = judged(spark, ([-100, 5, 6], [1, 5, 7]), ([-100], [3]))
    assert tuple(metrics.masked_accuracy(df).first()) == (1, 2, 0.5)
    assert [r[0] for r in df.select(metrics.example_accuracy(F.col("labels"), F.col("preds"))).collect()] == [0.5, 1.0]
    assert tuple(metrics.masked_accuracy(df.limit(0)).first()) == (0, 0, 0.0)
    assert tuple(metrics.token_accuracy(judged(spark, ([5, 0, 0], [5, 0, 1])), "labels", "preds", 0).first()) == (pytest.approx(2 / 3), 1.0)
    assert [tuple(r) for r in metrics.position_accuracy(judged(spark, ([5, 6], [5, 7]), ([5], [4])), "labels", "preds").orderBy("pos").collect()] == [(0, 2, 0.5), (1, 1, 0.0)]


def test_perplexity(spark):
    df = spark.createDataFrame([(1.0, 1.0), (3.0, 3.0)], "l double, n double")
    assert tuple(metrics.perplexity(df, F.col("l"), F.col("n")).first()) == (2.5, pytest.approx(math.exp(2.5)))
    assert metrics.perplexity(df, F.col("l"), F.col("n"), guard=2.0).first().perplexity == math.inf


def test_text_metrics(spark):
    df = spark.createDataFrame([("a b c d e".split(), "a b c d e".split()), ("x y".split(), [])], "r array<string>, c array<string>")
    assert metrics.bleu(df.limit(1), F.col("r"), F.col("c")).first().bleu == pytest.approx(1.0)
    assert [r[0] for r in df.select(metrics.rouge_l()(F.col("r"), F.col("c"))).collect()] == [1.0, 0.0]
    assert [r[0] for r in df.select(metrics.meteor_exact(F.col("r"), F.col("c"))).collect()] == [pytest.approx(1.0), 0.0]


def test_early_stop(spark):
    df = spark.createDataFrame(list(enumerate([3.0, 2.0, 2.5, 2.4, 1.0])), "e long, l double")
    out = metrics.early_stop(df, "e", "l", 2).orderBy("epoch").collect()
    assert [(r.best, r.bad, r.stop) for r in out] == [(3.0, 0, False), (2.0, 0, False), (2.0, 1, False), (2.0, 2, True), (1.0, 0, True)]
    assert metrics.argmax_rows(spark.createDataFrame([(1, 0, 2.0), (1, 1, 2.0)], "k int, p int, s double"), "k", "p", "s").first().p == 0


def test_statistics(spark):
    df = spark.createDataFrame([("train", ["trb", "tra"], "x" * 60, [1, 2]), ("train", ["tra", "trb"], "a", [1])], "split string, combo_feats array<string>, combo_id string, input_ids array<int>")
    assert tuple(stats.combo_counts(df).first()) == ("tra_trb", 2)
    assert tuple(stats.token_totals(df).first()) == ("train", 2, 3)
    assert stats.report(df, "combo_id", "combo_feats").first().example == "a"


@settings(max_examples=8, deadline=None)
@given(st.lists(st.sampled_from("ABI"), max_size=7))
def test_pairing_sizes(spark, chains):
    df = spark.createDataFrame([("c", i, ch, str(i)) for i, ch in enumerate(chains)], "cell string, i int, ch string, cdr3 string")
    df = df.withColumns({g: F.lit("") for g in ("v_gene", "d_gene", "j_gene")})
    out = pairing.pair_chains(df, "cell", "i", F.col("ch") == "A", F.col("ch") == "B").collect()
    a, b = chains.count("A"), chains.count("B")
    assert len(out) == (max(a, 1) * max(b, 1) if a + b else 0)
    assert sorted(r.tid for r in out) == sorted(f"c_{i + 1}" for i in range(len(out)))


def test_merges_of_all_words_beyond_the_bound(spark):
    """Rare words' pairs count: "xy" is in every rare word and in no frequent one."""
    rows = [("ab", 9), ("cd", 8), *((f"xy{c}", 2) for c in "klmnopqrstuvw"), ("aaaa", 3), ("éé", 2)]
    counts = spark.createDataFrame(rows, "word string, n long")
    whole = tokens.bpe_merges(counts, 8)
    assert whole[0] == ("x", "y")
    assert tokens.bpe_merges(counts, 8, most_words=3) == whole
    assert tokens.bpe_merges(counts, 99, most_words=3) == tokens.bpe_merges(counts, 99)
