import __spark_entry__ as entry
import corpus_pipeline
from tests.llm import brute
from tests.llm.test_text_ops import ITEM, labelled

NAMES = ["language_id", "near_dedup", "decontamination", "pii", "packing"]


def given(spark, docs, folder):
    rows = [(d, f"{t} word{d} {d}", lang, f"s{d % 3}") for d, t, lang, _ in labelled(60)]
    rows += [(900, f"so we read: {ITEM} and more of it", "en", "s1"), (901, "write to ann@mail.example.com or call +1 (988) 555-2485 the thing", "en", "s2"), (902, None, "en", "s2"), (903, "12 34 !", "en", "s2"), (904, rows[5][1], rows[5][2], "s0")]
    df = docs(*rows)
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, df


def test_stages(spark, docs, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    rows, df = given(spark, docs, tmp_path)
    stage = {n: (lambda d, f=f: f(spark, d, str(tmp_path))) for n, f in corpus_pipeline.STAGES}
    kept = {}
    for name in NAMES[:-1]:
        out = stage[name](df)
        assert out.columns == df.columns
        out.write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    texts = {r[0]: r[1] for r in rows}
    assert set(kept["language_id"]) == set(texts) - {902, 903}
    groups = brute.components([(d, t) for d, t in texts.items() if d in kept["language_id"]], 5)
    assert set(kept["near_dedup"]) == {d for d, (_, c) in groups.items() if c == d}
    assert 904 not in kept["near_dedup"]
    assert set(kept["decontamination"]) == set(kept["near_dedup"]) - {900}
    assert set(kept["pii"]) == set(kept["decontamination"])
    assert kept["pii"][901] == "write to [EMAIL] or call [PHONE] the thing"
    assert {d: t for d, t in kept["pii"].items() if d != 901} == {d: t for d, t in kept["decontamination"].items() if d != 901}
    packed = stage["packing"](df).collect()
    assert {r.doc_id for r in packed} == set(kept["pii"])
    whole = sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in packed)
    run = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(r.length for r in run) == sum(x[2] for x in whole)
    assert {(r.doc_id, r.doc_tokens) for r in run} == {(r.doc_id, r.doc_tokens) for r in packed}


def test_registered():
    names = entry.queries()
    assert "pipeline" in names
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}
    assert corpus_pipeline.ORACLE_SQL is None
