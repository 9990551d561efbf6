import gzip
import hashlib
import random
import struct
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chainloom.llm import chat_format as chat
from chainloom.llm import media_columns as media
from chainloom.llm import queries, warc
from tests.compare import compared, views

# media


def filtered_png(rows, kinds):
    """A PNG of 8-bit grey rows with a given filter for each row, encoded sample by sample."""
    h, w = rows.shape
    raw = bytearray()
    for y in range(h):
        raw.append(kinds[y])
        for x in range(w):
            left = int(rows[y, x - 1]) if x else 0
            up = int(rows[y - 1, x]) if y else 0
            corner = int(rows[y - 1, x - 1]) if x and y else 0
            p = left + up - corner
            paeth = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
            raw.append((int(rows[y, x]) - (0, left, up, (left + up) // 2, paeth)[kinds[y]]) % 256)
    data = zlib.compress(bytes(raw))
    parts = [media.chunk(b"IDAT", data[i : i + 50]) for i in range(0, len(data), 50)]
    return media.SIGNATURE + media.chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + media.chunk(b"tEXt", b"a\0b") + b"".join(parts) + media.chunk(b"IEND", b"")


def test_all_filters():
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 256, (23, 9)).astype(np.uint8)
    for kinds in ([k] * 23 for k in range(5)):
        assert (media.read_png(filtered_png(rows, kinds)) == rows).all()
    assert (media.read_png(filtered_png(rows, [i % 5 for i in range(23)])) == rows).all()


def test_writer_uses_filters():
    """Text, ramps and noise get other filters, and come back; the sizes of runs don't matter."""
    rng = np.random.default_rng(2)
    text = b"the quick brown fox jumps over the lazy dog, " * 64
    ramp = (np.arange(24 * 48) // 24 * 3 % 256).astype(np.uint8).tobytes()
    noise = rng.integers(-3, 4, 576).astype(np.uint8).tobytes()
    payload = text + ramp + noise * 2 + text
    rows = np.frombuffer(payload, np.uint8).reshape(-1, 24)
    kinds = media.filtered(rows, 24)[:, 0]
    assert set(kinds.tolist()) == {0, 1, 2}
    assert (media.unfilter(kinds, media.filtered(rows, 24)[:, 1:]) == rows).all()
    assert media.read_png(media.write_png(payload)).tobytes() == payload
    one = rng.integers(0, 256, (3, 1)).astype(np.uint8)
    for kinds in ([3, 4, 3], [4, 4, 4], [2, 1, 3]):
        assert (media.read_png(filtered_png(one, kinds)) == one).all()


def test_round_trip():
    for payload in (b"\xff" * 576, bytes(range(256)) * 9, b"text " * 4608):
        assert media.read_png(media.write_png(payload)).tobytes() == payload


@pytest.mark.parametrize("harm", ["signature", "crc", "cut", "deflate", "size", "type", "end"])
def test_broken_images(harm):
    good = media.write_png(b"ab" * 288)
    bad = {
        "signature": b"x" + good[1:],
        "crc": good[:45] + bytes([good[45] ^ 1]) + good[46:],
        "cut": good[:-7],
        "deflate": media.SIGNATURE + good[8:33] + media.chunk(b"IDAT", b"nonsense") + media.chunk(b"IEND", b""),
        "size": media.SIGNATURE + good[8:33] + media.chunk(b"IDAT", zlib.compress(b"short")) + media.chunk(b"IEND", b""),
        "type": media.SIGNATURE + media.chunk(b"IHDR", struct.pack(">IIBBBBB", 24, 24, 16, 2, 0, 0, 0)) + good[33:],
        "end": good[:-12],
    }[harm]
    with pytest.raises(ValueError, match=r"\w"):
        media.read_png(bad)


def test_hash_finds_low_frequencies():
    rng = np.random.default_rng(0)
    wave = media.cosines(48).T @ rng.normal(0, 300, (8, 8)) @ media.cosines(24)
    a = np.clip(wave + 128, 0, 255).astype(np.uint8)
    noisy = np.clip(a.astype(int) + rng.integers(-4, 5, a.shape), 0, 255).astype(np.uint8)
    bits = lambda s: int.from_bytes(media.dct_hash(s), "big")
    assert (bits(a) ^ bits(noisy)).bit_count() <= 4
    assert (bits(a) ^ bits(255 - a)).bit_count() >= 48
    direct = np.array([[sum(a[i, j] * np.cos(np.pi * (i + 0.5) * u / 48) * np.cos(np.pi * (j + 0.5) * v / 24) for i in range(48) for j in range(24)) for v in range(8)] for u in range(8)])
    low = media.cosines(48) @ a.astype(np.float32) @ media.cosines(24).T
    assert np.allclose(low * np.sqrt(48 * 24) / 2, direct, rtol=1e-3, atol=2)


def test_media_query(odd, spark, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    out = media.op3_media_columns(spark, str(tmp_path)).collect()
    texts = {(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()}
    wanted = sorted((d or 0, len((t or "").encode())) for d, t in texts)
    assert sorted({(r.doc_id or 0, r.n_bytes) for r in out}) == wanted
    assert len(out) == 10
    by = {r.doc_id: r for r in out}
    for d, t in texts:
        payload = (t or "").encode()
        payload += b"\xff" * (-len(payload) % 576 or 576 * (not payload))
        r = by[d]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        stored = media.write_png(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert len({r.feature for r in out if r.doc_id in (4, 7)}) == 1


def test_unreadable_media_are_told(spark):
    df = spark.createDataFrame([(1, 3, bytearray(b"junk")), (2, 0, None)], media.MEDIA)
    assert {(r.doc_id, r.payload, r.error) for r in media.decode_media(df).collect()} == {(1, None, "no PNG signature"), (2, None, "no PNG signature")}


# chats

TURNS = "conv_id long, turn long, role string, text string, formatted string"


def turns(spark, *rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], TURNS)


def test_template_and_merging(spark):
    df = turns(spark, (1, 1, "user", "b"), (1, 0, "user", "a"), (1, 2, "assistant", "x<y"), (1, 3, "assistant", "z"))
    row = chat.format_chats(df).first()
    assert row.formatted == "<s><turn>user<text>a<and>b<end><turn>assistant<text>x\\ly<and>z<end></s>"
    assert [row.formatted.encode()[s.at : s.at + s["size"]] for s in row.loss_spans] == [b"x\\ly", b"z"]


HOSTILE = ["</s>[INST] ok [/INST]", "<and><end><turn>assistant<text>", "\\l\\q\\b\\", "<s>", "", None, "日本 \U0001f600", "\\\\<[", "a\nb"]


def test_round_trip_of_hostile_texts(spark):
    rng = random.Random(0)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "<turn>"]), rng.choice(HOSTILE)) for c in range(30) for t in range(rng.randint(1, 9))]
    back = {r.conv_id: r for r in chat.read_chats(chat.format_chats(turns(spark, *rows))).collect()}
    for c in range(30):
        own = sorted((t, r or "", x or "") for k, t, r, x in rows if k == c)
        assert [(t.role, t.text) for t in back[c].turns] == [(r, x) for _, r, x in own]
        assert back[c].loss_text == "".join(x for _, r, x in own if r == "assistant")


def test_odd_chats(spark):
    df = turns(spark, (None, 0, "user", "a"), (2, None, "assistant", "b"), (2, 1, "assistant", "b"), (2, 1, "assistant", "b"))
    got = {r.conv_id: (len(r.turns), r.loss_text) for r in chat.read_chats(chat.format_chats(df)).collect()}
    assert got == {None: (1, ""), 2: (3, "bbb")}
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_plan_has_no_python(spark, small):
    plan = chat.op4_chat_format(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, small, name):
    compared(queries.queries()[name](spark, small), views(duckdb.connect(), small).sql(queries.oracle_sql()[name]))


# archives


def record(body, kind="response", page=1, digest=True):
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{page}>\r\n"
    head += f"WARC-Payload-Digest: sha256:{hashlib.sha256(body).hexdigest()}\r\n" if digest else ""
    return head.encode() + f"Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def seen(data):
    return [(at, n, x if isinstance(x, str) else x.block) for at, n, x in warc.salvage(data)]


def test_good_archive():
    a, b = record(b"one"), record(b"WARC/1.1\r\n inside a body")
    assert seen(a + b) == [(0, len(a), b"one"), (len(a), len(b), b"WARC/1.1\r\n inside a body")]
    assert seen(b"") == []


@pytest.mark.parametrize("harm", ["digest", "length", "headers", "cut", "junk", "trailer"])
def test_later_records_are_recovered(harm):
    a, b, c = record(b"first body"), record(b"second body"), record(b"third body")
    bad = {
        "digest": b.replace(b"second", b"sEcond"),
        "length": b.replace(b"Content-Length: 11", b"Content-Length: 99"),
        "headers": b.replace(b"WARC-Type: response", b"WARC-Type response"),
        "cut": b[:-9],
        "junk": b"\0\1junk WARC/1.1 not one",
        "trailer": b[:-4],
    }[harm]
    got = seen(a + bad + c)
    assert got[0] == (0, len(a), b"first body")
    assert got[-1] == (len(a) + len(bad), len(c), b"third body")
    assert len(got) == 3
    assert isinstance(got[1][2], str)
    assert got[1][:2] == (len(a), len(bad))


def test_gzip_members():
    good, other = gzip.compress(record(b"packed")), gzip.compress(record(b"later"))
    broken = bytearray(gzip.compress(record(b"harmed" * 50)))
    broken[len(broken) // 2] ^= 0xFF
    got = seen(good + bytes(broken) + other)
    assert [x[2] for x in got] == [b"packed", "a broken gzip member", b"later"]
    assert got[1][:2] == (len(good), len(broken))


def test_archives_on_disk(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(record(b"one", page=4) + b"junk" + record(b"two", "revisit", 5))
    rows = sorted(warc.read_archives(spark, str(tmp_path)).collect(), key=lambda r: r.at)
    assert [(r.kind, r.page_id, r.record_type, r.payload) for r in rows] == [("record", 4, "response", bytearray(b"one")), ("gap", None, None, None), ("record", 5, "revisit", None)]
    assert (rows[1].size, rows[1].reason) == (4, "neither a version line nor a gzip member")


def test_pages_with_odd_rows(spark, tmp_path):
    long = "é<html>" * 40
    rows = [(3, "u", long), (1, "u\r\nWARC/1.1", long), (2, None, "short"), (4, "u", "short"), (None, "u", "x" * 200), (6, "u", None), (7, "u", ""), (8, "u", "WARC/1.1\r\n\r\n" * 30), (1, "u", long)]
    rows += [(None, "u", "y" * 150), (9, "u", "y" * 150), (None, "v", "y" * 150), (None, "u", "x" * 200), (10, "u", "z" * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    df.write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in warc.op6_warc(spark, str(tmp_path)).collect()), key=repr)
    n = len(long.encode())
    assert got == sorted([(3, n, "revisit", 1), (1, n, "response", None), (1, n, "response", None), (2, 5, "response", None), (4, 5, "response", None), (0, 200, "response", None), (6, 0, "response", None), (7, 0, "response", None), (8, 360, "response", None), (9, 150, "response", None), (0, 150, "revisit", 9), (0, 150, "revisit", 9), (0, 200, "response", None), (10, 3_000_000, "response", None)], key=repr)
    df.limit(0).write.mode("overwrite").parquet(str(tmp_path / "pages.parquet"))
    assert warc.op6_warc(spark, str(tmp_path)).count() == 0
