"""What the training-data operators share: shared-folder tables, Arrow text access, word hashing.

A word is a run of bytes outside space and 0x09-0x0D of the text with A-Z lower-cased. On UTF-8 bytes that is
exactly ``bytes.lower().split()``, which neither touches non-ASCII letters nor splits at Unicode spaces.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT = 1 << 20  # bytes of a text that are split into words at a time
BATCH_BYTES = 8 << 20  # of an Arrow batch that goes to a Python worker, one row at least

#: How intermediate tables are written. Without its native library, Hadoop's local file system starts a program for each
#: file and folder that it makes, also for markers of success and for files of checksums, and each start holds the whole
#: memory of the JVM for a moment. Nothing reads such a marker, and Parquet has checksums of its own, verified on reading.
PLAIN = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false", "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "parquet.page.write-checksum.enabled": "true"}
VERIFIED = {"parquet.page.verify-checksum.enabled": "true"}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local session that names none (tests) gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='chainloom-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def bound_batches(spark: SparkSession) -> None:
    """Rows hold whole texts: Arrow batches are bounded by bytes, below what the session allows."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key)).rstrip("bB")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def give_back() -> None:
    """Return freed memory to the system at a task's end: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


class Workspace:
    """Intermediate tables of one operator call, written to the shared folder and read back.

    A written table cuts the lineage: a lost executor costs the tasks that read from it, not the work before it.
    Results are lazy and may still read the tables, so the folder goes when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        bound_batches(spark)
        self.root = f"{shared_dir(spark).rstrip('/')}/chainloom-{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.remove)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").options(**PLAIN).parquet(self.path(name))
        return self.spark.read.options(**VERIFIED).schema(df.schema).parquet(self.path(name))

    def remove(self) -> None:
        jvm, sc = self.spark._jvm, self.spark._jsc
        try:
            at = jvm.org.apache.hadoop.fs.Path(self.root)
            at.getFileSystem(sc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session may have ended before the interpreter
            return


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo folds; null ids have no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text of an Arrow column; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def segments(blob: bytes, size: int = SEGMENT) -> Iterator[bytes]:
    """Pieces of about size bytes that end where white space begins, so that no word is cut."""
    if len(blob) <= size:
        yield blob
        return
    at = 0
    while at < len(blob):
        end = min(len(blob), at + size)
        while end < len(blob) and blob[end] not in b" \t\n\v\f\r":
            end += 1
        yield blob[at:end]
        at = end


def word_hashes(blob: bytes) -> np.ndarray:
    """64-bit hashes of a text's words, in order."""
    parts = [
        np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
        for part in segments(blob)
        if (words := part.lower().split())
    ]
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint64)


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S1, _S2, _S3 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = (x ^ (x >> _S1)) * _M1
    x = (x ^ (x >> _S2)) * _M2
    return x ^ (x >> _S3)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """One hash for each window of width words, in order; a shorter non-empty sequence is one window."""
    if len(words) == 0:
        return words
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(words.tobytes(), seed=len(words))], np.uint64)
    n = len(words) - width + 1
    out = words[:n].copy()
    for i in range(1, width):
        out = mix(out) + words[i : i + n]
    return mix(out)
