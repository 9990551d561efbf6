import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainloom.llm import decontam, language_id, packing, pii, token_counts
from chainloom.llm.token_counts import vocabulary
from tests.llm import brute

# token counts


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(docs, name):
    texts = ["", "  a  b\n\n c ", "<|endoftext|> x <|endoftext|>", "a <|endo ftext|>", " ", "\t\n x  y z", "don't  we'll \x1c y", "İSTANBUL ΑΣ ﬁ ", "日本語 の  。 ok \U0001f600 x", None, "plain words of a text. And more"]
    path = vocabulary(name)
    if name.endswith("json"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        length = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    else:
        import sentencepiece

        length = lambda t, tok=sentencepiece.SentencePieceProcessor(model_file=path): len(tok.encode(t))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs(*enumerate(texts)), path, 4).collect()}
    assert got == {i: (len((t or "").encode()), length(t or ""), length(t or "") > 4) for i, t in enumerate(texts)}


def test_token_counts_of_odd_rows(odd):
    out = token_counts.count_tokens(odd, vocabulary("byte_bpe_50k.json"))
    assert out.count() == 10
    assert out.filter("doc_id = 5 AND over_limit").count() == 2
    assert token_counts.count_tokens(odd.limit(0), vocabulary("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"])
@pytest.mark.parametrize("window", [token_counts.WINDOW, 64])
def test_counts_of_random_texts(monkeypatch, name, window):
    """Against the library on whole texts: white space of all kinds, long texts, and texts without a safe boundary."""
    import pyarrow as pa

    monkeypatch.setattr(token_counts, "WINDOW", window)
    monkeypatch.setattr(token_counts, "BATCH_BYTES", 200)
    encoder = token_counts.Encoder(vocabulary(name))
    assert encoder.splits == (name != "word_bpe_49k.json")
    rng = random.Random(8)
    signs = ["a", "b", " ", " ", "  ", "'s", "é", "ß", "日", "\xa0", "\x85", "\u2003", "\u3000", "\n", "\t", "\x1c", "\x0b", "<|endoftext|>", "1", ".", "\U0001f600", "\u0301", "Σ", "\u2581"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += [None, "", " ", "x" * 3000, "word and " * 200, " a", "a ", "é é\xa0é"]
    length = (lambda t: len(encoder.tok.encode(t, add_special_tokens=False).ids)) if name.endswith("json") else (lambda t: len(encoder.tok.encode(t)))
    wanted = [length(t or "") for t in texts]
    assert encoder.counts(pa.array(texts)).tolist() == wanted
    assert encoder.counts(pa.array(texts).slice(100, 1000)).tolist() == wanted[100:1100]
    assert encoder.counts(pa.array([], pa.string())).tolist() == []


# packing


def test_chunk_ids(monkeypatch):
    monkeypatch.setattr(packing, "KEPT", 500)
    monkeypatch.setattr(packing, "PIECE", 90)
    chunks = packing.ChunkIds(vocabulary("word_bpe_49k.json"))
    rng = random.Random(4)
    letters = "aAzZéÉßñ.,;:!?*#%&$|\")]}-'<>0 9\t\n\x0b\x1cΣσİıÇµ日̈́"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(2000)] + ["<|endoftext|> x<|endoftext|>.", "don't. we'll, 's.", "x " * 500]
    texts += ["<|ENDOFTEXT|> a.<|endoftext|>b", "H\u0331. I\u0307, \u212a; \xb5. \xaa) \xd7. \xf7. \xbb.", "ab" * 4000 + "." + "\xe9" * 300]
    got = [x.tolist() for x in chunks.all(iter(texts))]
    assert got == [chunks.tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in chunks.all(iter(texts[-4:]))] == got[-4:]


def test_chunk_ids_of_another_vocabulary():
    """A vocabulary that keeps cases and white space isn't encoded by chunks."""
    encoder = packing.ChunkIds(vocabulary("byte_bpe_50k.json"))
    texts = ["The  the.\n", "", "Caf\xe9, x"]
    assert not encoder.chunked
    assert [x.tolist() for x in encoder.all(iter(texts))] == [encoder.tok.encode(t).ids for t in texts]


def pieces(df, targets=None):
    return sorted(packing.pack(df, vocabulary("word_bpe_49k.json"), targets).collect(), key=lambda r: (r.sequence_id, r.offset))


def checked(rows, given):
    """Every token once, sequences without gaps, and only the last one open."""
    import zlib

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    place = 0
    for r in rows:
        assert r.sequence_id * packing.WINDOW + r.offset == place
        assert r.length > 0
        place += r.length
    wanted = sorted(zlib.crc32(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for _, t in given)
    found, open_ = [], {}
    ids = {d: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t in given}
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        open_.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    for d, parts in open_.items():
        copies = sum(g[0] == d for g in given)
        assert sum(p[1] for p in parts) == copies * len(ids[d])
        found += [zlib.crc32(ids[d].tobytes())] * copies
    assert sorted(found) == wanted


def test_packing(docs):
    rng = random.Random(1)
    given = [(i, " ".join(rng.choice(["alpha", "beta", "gamma,"]) for _ in range(rng.randint(0, 900)))) for i in range(120)]
    rows = pieces(docs(*((d, t, "en", f"s{d % 3}") for d, t in given)))
    checked(rows, given)
    shares = {}
    for r in rows[: 3 * len(rows) // 4]:
        shares.setdefault(r.sequence_id // 4, {}).setdefault(r.source, []).append(r.length)
    whole = [{s: sum(v) / (4 * packing.WINDOW) for s, v in w.items()} for w in list(shares.values())[:-1]]
    total = {s: sum(r.length for r in rows if r.source == s) / sum(r.length for r in rows) for s in ("s0", "s1", "s2")}
    assert all(abs(w.get(s, 0) - total[s]) < 0.12 for w in whole for s in total)


def test_packing_to_given_targets(docs):
    given = [(i, "alpha beta gamma delta " * 150) for i in range(60)]
    rows = pieces(docs(*((d, t, "en", "ab"[d % 2]) for d, t in given)), {"a": 0.75, "b": 0.25})
    checked(rows, given)
    first = [r for r in rows if r.sequence_id < 8]
    assert abs(sum(r.length for r in first if r.source == "a") / sum(r.length for r in first) - 0.75) < 0.05


def test_packing_over_blocks(docs, monkeypatch):
    """Deficits and places run on from block to block."""
    from pyspark.sql import functions as F  # noqa: F401

    given = [(i, "alpha beta gamma delta " * (1 + i % 40)) for i in range(200)]
    df = docs(*((d, t, "en", "ab"[d % 2]) for d, t in given)).repartition(8)
    checked(pieces(df), given)


def test_packing_odd_rows(odd, docs):
    rows = pieces(odd)
    whole = packing.ChunkIds(vocabulary("word_bpe_49k.json")).tok.encode("x" * 300_000).ids
    assert sum(r.length for r in rows if r.doc_id == 8) == len(whole) + 1
    assert sum(r.length for r in rows if r.doc_id in (1, 2, 3)) == 3
    assert {r.doc_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert sum(r.length for r in rows if r.doc_id == 5) == 2 * next(r.doc_tokens for r in rows if r.doc_id == 5)
    assert any(r.doc_id is None for r in rows)
    assert pieces(odd.limit(0)) == []
    assert [(r.sequence_id, r.source) for r in pieces(docs((1, "a b", "en", None)))] == [(0, None)]


# decontamination

ITEM = "When the old miller counted 12 sacks of rye for Anna he gave 3 sacks back to Anna before the rain"


def found(spark, df, *items, **options):
    bench = spark.createDataFrame(list(items), "item_id long, text string").withColumn("doc_id", F.lit(0))
    return sorted((r.doc_id, r.item_id, r.slots) for r in decontam.leaks(df, bench, **options).collect())


@pytest.mark.parametrize("table", [10_000, 0])
def test_leaks(docs, spark, table):
    other = ITEM.replace("12", "40").replace("Anna", "Peter").replace("3 ", "7 ")
    inconsistent = ITEM.replace("12", "40").replace("for Anna", "for Peter").replace("to Anna", "to Clara")
    df = docs((1, f"Some words before. {ITEM}. And after"), (2, f"It said that {other}"), (3, inconsistent), (4, "When the old miller counted the days"), (5, None), (6, ITEM.upper() + " " + "tail " * 5), (7, ""))
    got = found(spark, df, (10, ITEM), (11, None), (12, "short item"), table=table)
    assert [(d, i) for d, i, _ in got if d != 6] == [(1, 10), (2, 10)]
    assert got[0][2] >= 4


def test_short_item_is_one_window(docs, spark):
    assert [x[:2] for x in found(spark, docs((1, "so we say: quick brown foxes jump over hedges today"), (2, "quick brown foxes sleep")), (1, "Quick brown foxes jump over"))] == [(1, 1)]


def test_leak_with_changed_units_and_numbers(docs, spark):
    item = "the road from the mill to the harbour is 30 km long and a cart needs 5 hours for all of it"
    assert [x[:2] for x in found(spark, docs((1, item.replace("30 km", "18 miles").replace("5 hours", "90 minutes"))), (1, item))] == [(1, 1)]


@pytest.mark.parametrize("table", [10_000, 0])
def test_copies_that_changed_their_case(docs, spark, table):
    spanish = "La canción de José habla de la emoción que María sintió en la estación cuando llegó el último tren"
    df = docs((6, ITEM.upper() + " tail"), (7, ITEM.lower()), (8, spanish.upper()), (9, f"Oí: {spanish.title()}"), (10, "La canción habla de otra estación y de otro tren"))
    assert [x[:2] for x in found(spark, df, (10, ITEM), (11, spanish), table=table)] == [(6, 10), (7, 10), (8, 11), (9, 11)]


@pytest.mark.parametrize("table", [10_000, 0])
def test_dense_and_short_items(docs, spark, table):
    items = ["Compute 3 times 4 plus 5 minus 2", "Convert 5 km 300 m to cm", "What is 12 + 7 * 3 - 4 / 2 ?", "Name three primes", "Paris"]
    df = docs(*((i, f"so it says {t} and goes on") for i, t in enumerate(items)), (10, "They ask: what is 9 + 8 * 5 - 6 / 1 ? It is"), (11, "what is 9 + 8 * 8 - 6 / 1 ?"), (12, "paris."), (13, "1 2 3 4 5 6 7 8"))
    assert [x[:2] for x in found(spark, df, *enumerate(items), table=table)] == [(0, 0), (1, 1), (2, 2), (3, 3), (10, 2), (12, 4)]


def test_one_changed_slot_hides_no_copy(docs, spark):
    """A copy with one of two equal names changed is a leak, word for word or with other slots before the change."""
    item = "In the old harbour Anna kept 12 boats and " + " ".join(f"word{c}" for c in "abcdefghijklmnopqrstuvwx") + " until the winter when Anna sold them all"
    copy = item.replace("when Anna", "when Clara")
    df = docs((1, copy), (2, copy.replace("Anna kept 12", "Peter kept 30")), (3, "In the old harbour Anna kept 12 boats for Clara"))
    assert [x[:2] for x in found(spark, df, (10, item))] == [(1, 10), (2, 10)]


@pytest.mark.parametrize("table", [10_000, 0])
def test_null_and_repeated_ids(docs, spark, table):
    """Both ways give a row for each document and item row, and drop leaked documents without an id but not their namesakes."""
    repeated = "one big red fox ran home " * 4
    df = docs((1, f"x {ITEM}"), (1, f"x {ITEM}"), (None, ITEM), (2, "clean"), (2, ITEM), (None, "clean too"), (3, repeated))
    bench = spark.createDataFrame([(None, ITEM), (5, ITEM), (5, "Quick brown foxes jump over"), (6, repeated)], "item_id long, text string")
    rows = decontam.leaks(df, bench, table=table).collect()
    assert sorted((r.doc_id or 0, r.item_id or 0) for r in rows) == [(0, 0), (0, 5), (1, 0), (1, 0), (1, 5), (1, 5), (2, 0), (2, 5), (3, 6)]
    out = decontam.decontaminate(df, bench, table=table)
    assert out.columns == df.columns
    assert sorted(r.text for r in out.collect()) == ["clean", "clean too"]


def test_decontaminated_documents(docs, odd, spark):
    bench = spark.createDataFrame([(10, ITEM)], "item_id long, text string")
    df = docs((1, f"x {ITEM} y"), (2, "a clean text"), (None, "no id"))
    out = decontam.decontaminate(df, bench)
    assert out.columns == df.columns
    assert sorted(r.doc_id or 0 for r in out.collect()) == [0, 2]
    assert decontam.decontaminate(odd, bench).count() == 10
    assert decontam.decontaminate(odd.limit(0), bench).count() == 0
    assert decontam.leaks(odd, bench.limit(0)).count() == 0


# personal data

PII_TEXTS = [
    "mail bosbt.42@mail8.example.com now, a@b.c_d@e.f x@y z@w.v.u. -a@-.-",
    "ip 42.144.35.254 and 300.1.1.1 and 1.2.3.4.5.6.7.8 and 001.02.3.0255",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112 or 1234567890123 or 4111  1111 1111 1111 12345678901234567890",
    "call +1 (988) 555-2485, +12 3, +1234567890123456 or ++44 20 7946 0958 +49-30-1234567-",
    "\U0001f600é both 10.0.0.1@x.y +1 212 555 0100 4111111111111111 end é",
    "",
    None,
    "no data here",
    "a" * 200_000,
    "1 " * 50_000,
]


def test_base_spans_equal_plain_patterns(docs):
    df = docs(*enumerate(PII_TEXTS), clash=False).select("doc_id", pii.joined(pii.base_spans(F.coalesce("text", F.lit("")))).alias("s"))
    assert {r.doc_id: r.s for r in df.collect()} == {i: brute.joined(brute.base_spans(t)) for i, t in enumerate(PII_TEXTS)}


def test_base_spans_of_random_texts(docs):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab@.1-  +(4_)é") for _ in range(rng.randint(0, 80))) for _ in range(800)]
    df = docs(*enumerate(texts), clash=False).select("doc_id", pii.joined(pii.base_spans(F.col("text"))).alias("s"))
    assert {r.doc_id: r.s for r in df.collect()} == {i: brute.joined(brute.base_spans(t)) for i, t in enumerate(texts)}


def secrets(n=8):
    rows = [(i, f"the agent callsign wrote a{i}@mail.example.com and went home") for i in range(n)]
    return rows + [(100 + i, f"the cat went home and wrote and wrote to the people of the town {'abcdefgh'[i % 8] * (3 + i)}") for i in range(40)] + [(200, "call +1 (988) 555-2485 me")]


def test_disclosing_terms(docs):
    out = pii.sanitise(docs(*secrets()))
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[0] == "the   wrote [EMAIL] and went home"
    assert "wrote" in texts[100]
    assert texts[200] == "call [PHONE] me"
    assert out.columns == docs(*secrets()).columns


def people(n=240):
    """Texts of which some hold addresses: names beside one person's address only, words beside any, and common words."""
    rng = random.Random(6)
    common = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    prose = lambda k: " ".join(rng.choice(common) for _ in range(k))
    texts = []
    for i in range(n):
        p = i % 6
        if i % 4 == 0:
            texts.append(f"{prose(4)} Contact Zelda{'abcdef'[p]} at p{p}@mail.example.com {prose(30)}. Later zelda{'abcdef'[p]}, {prose(3)}")
        elif i % 4 == 1:
            texts.append(f"{prose(rng.randint(1, 30))} Contact nobody")
        else:
            texts.append(prose(rng.randint(1, 40)) + (f" zelda{'abcdef'[p]} was here" if i % 60 == 2 else ""))
    return texts + texts[:5] + [texts[0]] * 7 + ["é 10.0.0.1 Ünïque", "ünïque 10.0.0.1 é x", ""]


def test_disclosing_spans_equal_brute_force(spark, tmp_path):
    """The whole query, by the definition: values and kinds, copies counted once, replacement throughout a value's texts."""
    texts = people()
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in pii.op5_pii(spark, str(tmp_path)).collect()}
    wanted = brute.disclosed(texts, pii.CONTEXT, pii.LETTERS, pii.GENERALISE, pii.REMOVE)
    assert sum(map(len, wanted)) > 60
    assert any(b > len(t) - 20 for t, w in zip(texts, wanted, strict=True) for _, b, _ in w)  # far from the address
    for i, t in enumerate(texts):
        base = brute.base_spans(t)
        assert got[i].base_sha256 == brute.sha(brute.joined(base))
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(k == x for _, k, _ in base) for x in range(4))
        every = sorted([(a, k, b) for a, k, b in base] + [(a, {"generalise": 4, "remove": 5}[w], b) for a, b, w in wanted[i]])
        assert got[i].spans == ",".join(f"{pii.ALL_KINDS[k]}:{a}:{b}" for a, k, b in every)


def test_copies_add_no_support(docs):
    rows = [(i, "the agent callsign wrote a@mail.example.com and went") for i in range(9)]
    assert {r.text for r in pii.sanitise(docs(*rows)).collect()} == {"the agent callsign wrote [EMAIL] and went"}


def test_sanitise_odd_rows(odd):
    out = pii.sanitise(odd)
    assert out.count() == 10
    assert out.filter("text IS NULL").count() == 1
    assert pii.sanitise(odd.limit(0)).count() == 0


def test_pii_plan_has_no_python(spark, docs):
    plan = pii.sanitise(docs(*secrets(2)))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


# language


def tongue(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def labelled(n=240):
    rng = random.Random(0)
    bags = {"en": ["the", "of", "thing", "and", "with"], "fr": ["le", "où", "elle", "dans", "eaux"], "de": ["der", "ung", "keit", "und", "schön"]}
    return [(i, tongue(rng, bags[x], rng.randint(3, 30)), x, "s") for i in range(n) for x in [rng.choice(list(bags))]]


def test_held_out_accuracy(docs):
    rows = labelled()
    df = docs(*rows)
    model = language_id.fit(df, F.col("doc_id") % 4 != 2)
    out = df.select("doc_id", language_id.predicted(model, F.col("text")).alias("p")).filter("doc_id % 4 = 2").collect()
    truth = {r[0]: r[2] for r in rows}
    assert sum(r.p.lang_pred == truth[r.doc_id] for r in out) / len(out) > 0.97
    assert all(0 <= r.p.score <= 1 for r in out)


def test_calibrated_scores(docs):
    """Few texts calibrate: the limits lie below what all of them have, and above none of the others' by much."""
    rows = labelled(700)
    model = language_id.fit(docs(*rows), F.lit(True))
    assert 0.25 <= model.temperature <= 8
    out = docs(*rows).select(language_id.predicted(model, F.col("text")).alias("p")).select("p.*")
    assert out.filter("accepted").count() >= 698
    junk = docs(*((i, "zqxj vvkw qqpz jjxq wzzk", "en", "s") for i in range(5)))
    assert junk.filter(language_id.predicted(model, F.col("text"))["accepted"]).count() == 0


@pytest.mark.parametrize("doc_id", [1, 2, 3, None])
def test_rows_that_share_an_id(docs, doc_id):
    """Places are by id and text: equal ids don't empty or fill the sample; equal rows are one."""
    rows = [(doc_id, *r[1:]) for r in labelled(4000)]
    known = language_id.labelled(docs(*rows), F.lit(True))
    x, y, languages = language_id.sample(known)
    assert languages == ["de", "en", "fr"]
    assert 3 * 500 < len(x) <= 3 * language_id.PER_LANGUAGE
    assert language_id.chosen(known, False).count() < 3 * 1.5 * language_id.PER_LANGUAGE
    same = docs(*[(doc_id, "the same text and thing", "en", "s")] * 3000, *labelled(60))
    assert len(language_id.sample(language_id.labelled(same, F.lit(True)))[0]) <= 61


def test_every_language_is_learned(docs):
    """More languages than the sample has texts: each keeps one at least."""
    rows = [(10 * i + j, f"{w} {w}{j} {w}x", w, "s") for i in range(300) for w in ["".join(chr(97 + (i * k + k * k) % 26) for k in range(3, 9)) + chr(97 + i % 26) + chr(97 + i // 26)] for j in range(3)]
    model = language_id.fit(docs(*rows), F.lit(True))
    assert len(model.languages) == 300


def test_language_of_odd_rows(docs, odd):
    model = language_id.fit(docs(*labelled(), (900, "unlabelled", None, "s")), F.lit(True))
    assert model.languages == ["de", "en", "fr"]
    out = odd.select("doc_id", language_id.predicted(model, F.col("text")).alias("p")).select("doc_id", "p.*").collect()
    assert {r.doc_id for r in out if r.lang_pred == "und"} == {1, 2, 3}
    assert all(not r.accepted and r.score == 0 for r in out if r.lang_pred == "und")
    assert odd.limit(0).select(language_id.predicted(model, F.col("text"))).count() == 0
    assert language_id.fit(odd.limit(0), F.lit(True)) is None
    nothing = language_id.fit(docs((1, "x", None, "s")), F.lit(True))
    assert nothing is None
    assert odd.select(language_id.predicted(None, F.col("text"))["lang_pred"]).distinct().first()[0] == "und"


def test_bounded_sample(docs, monkeypatch):
    monkeypatch.setattr(language_id, "PER_LANGUAGE", 20)
    x, y, _ = language_id.sample(language_id.labelled(docs(*labelled()), F.lit(True)))
    assert len(x) == len(y) <= 60
    assert x.dense(np.arange(len(x))).sum(axis=1) == pytest.approx(np.ones(len(x)), abs=1e-4)


@pytest.mark.parametrize("languages", [["en"], ["de", "en", "fr"]])
def test_unlearned_languages_are_rejected(docs, languages):
    """With enough other texts for the quantile, texts of no learned language are rejected and clean ones kept."""
    rows = [r for r in labelled(6000) if r[2] in languages]
    if len(languages) == 1:
        rows = [(3 * r[0] + i, *r[1:]) for r in rows for i in range(2)]
    df = docs(*rows, clash=False)
    model = language_id.fit(df, F.lit(True))
    assert model.atypical > -np.inf
    rng = random.Random(5)
    foreign = ["".join(rng.choice(letters) for _ in range(60)) for letters in ("абвгдежзик лмнопрст", "的一是不了人我在有他", "0123456789abcdef ", "aąbcćeęłńóśźż klmnprstwyz ") for _ in range(25)]
    accepted = language_id.predicted(model, F.col("text"))["accepted"]
    assert docs(*enumerate(foreign), clash=False).filter(accepted).count() == 0
    assert df.filter(accepted).count() >= 0.99 * len(rows)


def test_language_is_learned_from_all_rows(docs, monkeypatch):
    """Beyond the sample every row counts once, in sums and limits, however rows are dealt out or repeated."""
    monkeypatch.setattr(language_id, "PER_LANGUAGE", 20)
    monkeypatch.setattr(language_id, "REJECTED", 20)
    rng = random.Random(3)
    rows = labelled(900) + [(5000 + i, tongue(rng, ["zqxj", "vvkw", "qqpz", "jjxq"], 20), "en", "s") for i in range(40)]
    df = docs(*rows)
    model = language_id.fit(df, F.lit(True))
    known = language_id.labelled(df, F.lit(True))
    assert not known.whole() and not known.repeated
    total = np.zeros((language_id.BUCKETS, 3))
    for r in known.rows.filter(~known.calibrates()).collect():
        c = language_id.counts(r.text)
        total[:, model.languages.index(r.lang)] += c / c.sum()
    assert 800 < total.sum() < 890
    assert model.typical == pytest.approx(language_id.log_shares(total), abs=1e-4)
    odd = docs(*((i, tongue(rng, ["zqxj", "vvkw", "qqpz", "jjxq"], 20), "de", "s") for i in range(9)))
    assert {r[0] for r in odd.select(language_id.predicted(model, F.col("text"))["lang_pred"]).collect()} == {"en"}
    held = sorted(r[0] for r in known.rows.filter(known.calibrates()).select(language_id.predicted(model, F.col("text"))["score"]).collect())
    assert len(held) >= 2 * 20
    assert model.rejecting == pytest.approx(held[len(held) // 40], abs=1e-6)
    for other in (docs(*rows).repartition(7).sortWithinPartitions("lang"), docs(*sorted(rows, key=lambda r: r[2])).coalesce(1), docs(*rows, *rows)):
        again = language_id.fit(other, F.lit(True))
        assert again.table == pytest.approx(model.table, abs=1e-3)
        assert again[4] == pytest.approx(model.rejecting, abs=1e-4)
        assert again.typical == pytest.approx(model.typical, abs=1e-4)
