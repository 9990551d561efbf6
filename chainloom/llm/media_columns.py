"""Operator 3: PNG images in binary columns, with low-frequency cosine-transform hashes.

Payload bytes become 8-bit grey samples of an image 24 samples wide. The writer emits signature, IHDR, IDAT and IEND
with their CRC-32; the rows of each frame have the filter, of none, left and up, whose samples are the least in sum. The
reader checks signature, order, lengths, every CRC and the inflated size, then undoes the row filters in numpy: all five
types, rows in a run of one type together; types whose samples depend on two neighbours go by diagonals.

Defined results: a null text is an empty payload and gives one frame of fill bytes; a null doc_id stays null; repeated
rows each give a row with equal values; ties between filters go to the lower type; a very long text is one tall image; an
empty table gives no rows; other columns are ignored. Broken media raise
ValueError from ``read_png``; ``decode_media`` turns that into a null payload and a message in ``error``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.llm.common import as_bytes, documents

SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed value of the format
WIDTH = 24
FRAME = 576
FILL = b"\xff"
LEVEL = 1  # of deflate: the payloads are stored once and read back at once
OUT_BYTES = 8 << 20  # bytes of binary values in an Arrow batch that is passed on

MEDIA = "doc_id long, n_bytes long, media binary"
DECODED = "doc_id long, n_bytes long, media binary, payload binary, dct_hash binary, error string"


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def filtered(rows: np.ndarray, band: int) -> np.ndarray:
    """Rows with their filter type first: for each band of rows the type, of 0 to 2, with the least sum of samples as signed numbers."""
    each = np.stack([rows, rows, rows])
    each[1, :, 1:] -= rows[:, :-1]
    each[2, 1:] -= rows[:-1]
    size = np.abs(each.view(np.int8).astype(np.int16)).sum(axis=2)
    kinds = np.add.reduceat(size, np.arange(0, len(rows), band), axis=1).argmin(axis=0).repeat(band)[: len(rows)]
    out = np.empty((len(rows), rows.shape[1] + 1), np.uint8)
    out[:, 0] = kinds
    out[:, 1:] = each[kinds, np.arange(len(rows))]
    return out


def write_png(payload: bytes, width: int = WIDTH) -> bytes:
    """An 8-bit grey image without interlace."""
    if not payload or len(payload) % width:
        raise ValueError(f"payload of {len(payload)} bytes isn't whole rows of {width}")
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    header = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    data = zlib.compress(filtered(rows, FRAME // WIDTH).tobytes(), LEVEL)
    return SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", data) + chunk(b"IEND", b"")


def chunks(media: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Kind and data of each chunk, after its CRC has been tested."""
    if media[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at = 8
    while at < len(media):
        if at + 12 > len(media):
            raise ValueError(f"chunk cut off at byte {at}")
        (size,) = struct.unpack_from(">I", media, at)
        if at + 12 + size > len(media):
            raise ValueError(f"chunk at byte {at} is longer than the file")
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError(f"bad CRC of {kind!r} at byte {at}")
        yield kind, data
        at += 12 + size


def by_diagonals(kind: int, rows: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Undo filter 3 or 4 of a run of rows: samples of a diagonal depend on the two diagonals before it only."""
    high, wide = rows.shape
    out = np.zeros((high + 1, wide + 1), np.int16)  # with the row above and a column of zeros
    out[0, 1:] = above
    for d in range(high + wide - 1):
        y = np.arange(max(0, d - wide + 1), min(high, d + 1))
        x = d - y
        left, up = out[y + 1, x], out[y, x + 1]
        if kind == 3:
            guess = (left + up) >> 1
        else:
            corner = np.where(x > 0, out[y, x], 0)
            p = left + up - corner
            a, b, c = np.abs(p - left), np.abs(p - up), np.abs(p - corner)
            guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        out[y + 1, x + 1] = (rows[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undo the filters of rows with one byte a sample."""
    if len(kinds) and kinds.max() > 4:
        raise ValueError(f"unknown filter {kinds.max()}")
    out = np.empty_like(rows)
    above = np.zeros(rows.shape[1], np.uint8)
    cuts = [0, *(np.flatnonzero(kinds[1:] != kinds[:-1]) + 1).tolist(), len(rows)]
    for at, end in zip(cuts[:-1], cuts[1:], strict=True):
        kind, part = kinds[at], rows[at:end]
        if kind == 0:
            out[at:end] = part
        elif kind == 1:  # sums along each row
            np.add.accumulate(part, axis=1, dtype=np.uint8, out=out[at:end])
        elif kind == 2:  # sums down the rows
            np.add.accumulate(part, axis=0, dtype=np.uint8, out=out[at:end])
            out[at:end] += above
        else:
            out[at:end] = by_diagonals(kind, part, above)
        above = out[end - 1]
    return out


def read_png(media: bytes) -> np.ndarray:
    """Samples (height, width) of an 8-bit grey image; ValueError says what is wrong with a broken one."""
    shape, data, kind = None, [], b""
    for kind, value in chunks(media):
        if shape is None:
            if kind != b"IHDR" or len(value) != 13:
                raise ValueError("the first chunk isn't IHDR")
            width, height, *form = struct.unpack(">IIBBBBB", value)
            if form != [8, 0, 0, 0, 0] or not width or not height:
                raise ValueError(f"not an 8-bit grey image without interlace: {form}")
            shape = height, width
        elif kind == b"IDAT":
            data.append(value)
    if shape is None or kind != b"IEND":
        raise ValueError("no IEND at the end")
    size = shape[0] * (shape[1] + 1)
    inflate = zlib.decompressobj()
    try:
        raw = inflate.decompress(b"".join(data), size + 1)
    except zlib.error as e:
        raise ValueError(f"bad deflate stream: {e}") from e
    if len(raw) != size:
        raise ValueError(f"{len(raw)} bytes of samples instead of {size}")
    raw = np.frombuffer(raw, np.uint8).reshape(shape[0], shape[1] + 1)
    return unfilter(raw[:, 0], raw[:, 1:])


@lru_cache(maxsize=256)
def cosines(n: int) -> np.ndarray:
    """The first eight rows of the orthogonal cosine transform of n samples."""
    k, x = np.arange(8)[:, None], np.arange(n)[None, :]
    return (np.cos(np.pi * (x + 0.5) * k / n) * np.sqrt(2 / n)).astype(np.float32)


def dct_hash(samples: np.ndarray) -> bytes:
    """64 bits: which of the 8 by 8 lowest frequencies exceed their median, the constant term left out of it.

    Coefficients are rounded to a tenth of a grey level, so that the bits don't depend on the order of additions.
    """
    tall = cosines(samples.shape[0]) if samples.shape[0] <= 4096 else cosines.__wrapped__(samples.shape[0])
    low = np.round(tall @ samples.astype(np.float32) @ cosines(samples.shape[1]).T, 1).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def bounded(rows: Iterator[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of rows; a batch ends when its binary values reach OUT_BYTES."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if size >= OUT_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8, filled up to whole frames, as a PNG in a binary column."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, blob in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                    yield doc_id, len(blob), write_png(blob + FILL * (-len(blob) % FRAME or FRAME * (not blob)))

        yield from bounded(rows(), ["doc_id", "n_bytes", "media"], [pa.int64(), pa.int64(), pa.binary()])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encoded, MEDIA)


def decode_media(media: DataFrame) -> DataFrame:
    """Reads the stored bytes back: payload and hash, or the reason why an image can't be read."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, n, stored in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    try:
                        samples = read_png(stored or b"")
                        yield doc_id, n, stored, samples.tobytes(), dct_hash(samples), None
                    except ValueError as e:
                        yield doc_id, n, stored, None, None, str(e)

        types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.string()]
        yield from bounded(rows(), ["doc_id", "n_bytes", "media", "payload", "dct_hash", "error"], types)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(decoded, DECODED)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = decode_media(encode_media(documents(spark, sf_dir)))
    tail = F.expr("substring(payload, -32, 32)")
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.lower(F.hex("dct_hash")).alias("feature"),
    )
