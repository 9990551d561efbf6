"""The queries themselves, over whole supplied tables and a few odd rows, against plain Python."""

import random
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from chainloom.llm import decontam
from chainloom.llm.token_counts import vocabulary
from tests.llm import brute


@pytest.fixture(scope="module")
def folder(spark, small, tmp_path_factory):
    """The smallest supplied tables, with null, empty, blank, long, repeated and re-parameterised rows."""
    at = tmp_path_factory.mktemp("tables")
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang", "source")
    items = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    rng = random.Random(1)
    long = " ".join(rng.choice(["alpha", "Beta,", "12", "ürgh", "x.y"]) + str(rng.randint(0, 50)) for _ in range(30_000))
    odd = [(900_000, None), (900_001, ""), (900_002, " \t\n "), (900_003, "12 !"), (900_004, long), (900_005, "x" * 100_000), (900_006, "one two"), (900_007, "one two"), (900_008, items[0].upper()), (900_009, f"see {items[1]} there"), (900_010, " ".join(items[2].split()[:9]))]
    extra = spark.createDataFrame([(d, t, "en" if d % 2 else None, None) for d, t in odd], docs.schema)
    docs.unionByName(extra).write.parquet(f"{at}/documents.parquet")
    spark.read.parquet(f"{small}/benchmark.parquet").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


@pytest.fixture(scope="module")
def texts(spark, folder):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


def rows(spark, folder, name):
    return entry.queries()[name](spark, folder).collect()


def test_op1(spark, folder, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows(spark, folder, "op1_minhash_dedup")}
    assert got == {d: (n, c, c == d) for d, (n, c) in brute.components(list(texts.items()), 4).items()}


def test_op2(spark, folder, texts):
    labels = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r.doc_id: r for r in rows(spark, folder, "op2_language_id")}
    assert got.keys() == texts.keys()
    held = [d for d in texts if brute.fold(d, 4) == 2]
    for d, t in texts.items():
        assert got[d].held_out == (brute.fold(d, 4) == 2)
        assert (got[d].lang_pred == "und") == (not any(map(str.isalpha, t or "")))
        assert 0 <= got[d].score <= 1
        assert got[d].lang_pred in {"und", *(labels[x] for x in texts if x not in held)}
    clean = [d for d in held if labels[d] and texts[d] and len(texts[d]) > 60 and d < 900_000]
    assert sum(got[d].lang_pred == labels[d] for d in clean) >= 0.95 * len(clean)


def test_op7(spark, folder, texts):
    items = {r.item_id: brute.template(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    got = sorted((r.doc_id, r.item_id, r.windows, r.of_windows) for r in rows(spark, folder, "op7_decontam"))
    wanted = []
    for d, t in texts.items():
        doc = brute.template(t)
        if len(doc) > 5000:  # an item in one of them would be found by its words
            assert not any(" ".join(w for _, w in i) in " ".join(w for _, w in doc) for i in items.values())
            continue
        wanted += [(d, i, *found) for i, item in items.items() if (found := brute.leak(item, doc, decontam))]
    assert got == sorted(wanted)
    assert {900_008, 900_009} <= {d for d, *_ in got}


def test_op8(spark, folder, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    ids = {d: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t in texts.items()}
    found = sorted(rows(spark, folder, "op8_packing"), key=lambda r: (r.sequence_id, r.offset))
    place, seen = 0, {}
    for r in found:
        assert r.sequence_id * 2048 + r.offset == place
        assert r.offset + r.length <= 2048
        place += r.length
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
    for d, own in ids.items():
        at = 0
        for start, n in sorted(seen[d]):
            assert start == at
            at += n
        assert at == len(own)


def test_op9(spark, folder, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows(spark, folder, "op9_token_counts")}
    for d, t in texts.items():
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert got[d] == (len((t or "").encode()), n, n > 512)


def test_op10(spark, folder, texts):
    got = {r.doc_id: r for r in rows(spark, folder, "op10_class_lm")}
    wanted = brute.unigram(list(texts.items()), lambda d: brute.fold(d, 7) == 2)
    assert got.keys() == wanted.keys()
    for d, (n, known, total, base) in wanted.items():
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, brute.fold(d, 7) == 2)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.perplexity == pytest.approx(10 ** (-r.score / n), rel=1e-9)
    held = [d for d in texts if brute.fold(d, 7) == 2]
    assert sum(got[d].score for d in held) > sum(got[d].base_score for d in held)
