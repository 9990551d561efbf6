"""Operator 8: mixture-controlled packing by deficit round-robin over source queues.

1. Documents are dealt by a hash, encoded once, and written as blocks of some thousand documents' ids at most, so every
   block holds about the corpus's mixture.
2. Sums over blocks and sources, and running sums in two levels, give each block its place in the one global stream of
   tokens and the deficit that every source brings along: what its target share of all earlier tokens lacks.
3. Each block runs its rounds alone: a source's deficit grows by its share of a window; it is served once it may send
   MIN_PIECE tokens or its rest; what it may not send is carried on. The stream is cut at window ends, so windows run
   on from block to block and only the last window of all has padding.

Defined results: a null text is empty and has its end id alone; null doc_id and null source are values of their own;
repeated rows are documents of their own; an empty table gives no rows; other columns are ignored. Encoding is by
chunks, cut at ASCII white space and where a letter meets punctuation, which the library's normaliser and pre-tokeniser
never join; that the vocabulary has these properties is tested, and one that hasn't them gets whole texts. Equal chunks
of some megabytes of text are looked up once, and a task keeps the ids of recurring chunks in bounded bytes. Very long
texts are taken piece by piece; a text without white space is one chunk, whatever its length.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainloom.llm.common import Workspace, documents, give_back
from chainloom.llm.token_counts import vocabulary

WINDOW = 2048
END_ID = 1
MIN_PIECE = 256  # tokens that a source is served at least, its rest apart
BLOCK_TOKENS = 1 << 19
#: A letter, and punctuation at which the pre-tokeniser ends a run of letters whatever follows.
WORD_ENDS = r'([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}])([.,;:!?*#%&$")\]}-])'
LOWER = bytes(ord(c) if len(c := chr(x).lower()) == 1 and ord(c) < 256 else x for x in range(256))
KEPT_BYTES = 24 << 20  # of chunks and ids in a generation of those that a task keeps
KEPT = 150_000  # chunks in a generation
BATCH = 8192  # unseen chunks that go to the library at once
PIECE = 2 << 20  # bytes of text whose chunks are looked up together

#: The normaliser and pre-tokeniser for which chunks may be encoded apart.
NORMALISERS = [("NFC", None, None), ("Replace", "\\s+", " "), ("Lowercase", None, None)]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

BLOCKS = "block long, docs array<struct<doc_id:long,source:string,n:long>>, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def splits_at_blanks(described: dict) -> bool:
    """Whether a tokenizer lower-cases, drops white space and cuts as the encoding by chunks relies on."""
    normal, cut, model = described.get("normalizer") or {}, described.get("pre_tokenizer") or {}, described["model"]
    steps = [(n["type"], n.get("pattern", {}).get("Regex"), n.get("content")) for n in normal.get("normalizers", [])]
    first, *rest = [*cut.get("pretokenizers", []), {}]
    split = (first.get("type"), first.get("pattern", {}).get("Regex"), first.get("behavior"), first.get("invert")) == ("Split", SPLIT, "Removed", True)
    mapped = [(r.get("type"), r.get("add_prefix_space"), r.get("use_regex")) for r in rest if r] == [("ByteLevel", False, False)]
    plain = model["type"] == "BPE" and not model.get("dropout") and not any(t["normalized"] or t["lstrip"] or t["rstrip"] for t in described["added_tokens"])
    return steps == NORMALISERS and split and mapped and plain and described.get("post_processor") is None


def one_case(text: str) -> str:
    """Texts that differ in case only are the same to the normaliser: lower-cased if case is one to one there (Latin-1).

    Special tokens are found before that, so texts that might hold one stay as they are.
    """
    if "<|" in text:
        return text
    try:
        return text.encode("latin-1").translate(LOWER).decode("latin-1")
    except UnicodeEncodeError:
        return text


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)).difference(own)))}


LETTERS = byte_letters()


class ChunkIds:
    """Ids of texts, by way of their white-space chunks.

    Ids of chunks are kept in two generations of bounded bytes: when the newer one is full it becomes the older one, so
    that frequent chunks stay. Unseen words go to the library's model; other unseen chunks go to the library joined by a
    special token's string, which it cuts out before anything else, and are told apart by that token's id; chunks that
    hold the string go alone. With a vocabulary that isn't known to cut at white space, whole texts go to the library.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.chunked = splits_at_blanks(json.loads(self.tok.to_str()))
        special = [(i, t.content) for i, t in self.tok.get_added_tokens_decoder().items() if t.special]
        self.cut, self.between = special[-1] if special else (-1, "")
        self.model = self.tok.model
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def put(self, chunk: str, ids: bytes) -> None:
        self.new[chunk] = ids
        self.size += len(chunk) + len(ids)

    def learn(self, chunks: list[str]) -> None:
        """Keep the ids of chunks that neither generation has."""
        together, alone = [], []
        for x in chunks:
            if x.isalpha() and x.islower() and (x.isascii() or max(x) < "\u0100"):  # one piece for the pre-tokeniser, and normal already
                self.put(x, array("I", [t.id for t in self.model.tokenize(x if x.isascii() else "".join(map(LETTERS.__getitem__, x.encode())))]).tobytes())
            else:
                (together if self.between and self.between not in x else alone).append(x)
        for at in range(0, len(together), BATCH):
            part = together[at : at + BATCH]
            ids = np.array(self.tok.encode_batch_fast([self.between.join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.append(np.flatnonzero(ids == self.cut), len(ids)).tolist()
            raw, begin = ids.tobytes(), 0
            for x, end in zip(part, ends, strict=True):
                self.put(x, raw[4 * begin : 4 * end])
                begin = end + 1
        for x in alone:
            self.put(x, self.direct(x))

    def direct(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of different chunks."""
        if self.size > KEPT_BYTES or len(self.new) > KEPT:
            self.old, self.new, self.size = self.new, {}, 0
        unseen = []
        for x in chunks:
            if x not in self.new:
                if (got := self.old.get(x)) is not None:
                    self.put(x, got)
                else:
                    unseen.append(x)
        self.learn(unseen)
        return list(map(self.new.__getitem__, chunks))

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts, one after the other, and each text's number of them. Equal chunks are looked up once."""
        if not self.chunked:
            each = [self.direct(x) for x in texts]
            return np.frombuffer(b"".join(each), "<u4"), np.array([len(x) // 4 for x in each], np.int64)
        spaced = pc.replace_substring_regex(pa.array(map(one_case, texts), pa.large_string()), WORD_ENDS, r"\1 \2")
        chunks = pc.ascii_split_whitespace(spaced)
        ends = chunks.offsets.to_numpy().astype(np.int64)
        coded = chunks.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
        code = coded.indices.to_numpy()
        found = self.of_chunks(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begin = np.concatenate([[0], np.cumsum(size)])[:-1]
        n = size[code]
        below = np.concatenate([[0], np.cumsum(n)])
        flat = np.frombuffer(b"".join(found), "<u4")
        return flat[np.arange(below[-1]) + np.repeat(begin[code] - below[:-1], n)], np.diff(below[ends - ends[0]])

    def all(self, texts: Iterator[str]) -> Iterator[np.ndarray]:
        """Ids of each text, in order; texts are taken together up to PIECE characters, longer ones cut at white space."""
        held: list[str] = []
        size = 0

        def out() -> Iterator[np.ndarray]:
            ids, n = self.ids(held)
            yield from np.split(ids, np.cumsum(n)[:-1])

        for t in texts:
            if size + len(t) > PIECE and held:
                yield from out()
                held, size = [], 0
            if len(t) > PIECE and self.chunked:
                yield np.concatenate([self.ids([part])[0] for part in pieces(t)])
            else:
                held.append(t)
                size += len(t)
        if held:
            yield from out()


def pieces(text: str) -> Iterator[str]:
    """Pieces of a text of any length, which end where white space begins."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end] not in " \t\n\r":
            end += 1
        yield text[at:end]
        at = end


def encode_blocks(docs: DataFrame, path: str) -> DataFrame:
    """Rows of BLOCKS; ids are 16-bit where the vocabulary allows, each document's with END_ID at the end."""
    end = np.array([END_ID], "<u4")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, first = ChunkIds(path), TaskContext.get().partitionId() << 32
        schema = pa.schema([("block", pa.int64()), ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("source", pa.string()), ("n", pa.int64())]))), ("ids", pa.binary())])
        held: list[dict] = []
        ids: list[np.ndarray] = []
        tokens = made = 0

        def block() -> pa.RecordBatch:
            joined = np.concatenate(ids)
            stored = joined.astype("<u2") if encoder.tok.get_vocab_size() <= 1 << 16 else joined
            return pa.RecordBatch.from_arrays([pa.array([first + made], pa.int64()), pa.array([held], schema.field(1).type), pa.array([stored.tobytes()], pa.binary())], schema=schema)

        for batch in batches:
            texts = (x.as_py() or "" for x in batch.column(2))
            for doc_id, source, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), encoder.all(texts), strict=True):
                held.append({"doc_id": doc_id, "source": source, "n": len(own) + 1})
                ids += [own, end]
                tokens += len(own) + 1
                if tokens >= BLOCK_TOKENS:
                    yield block()
                    held, ids, tokens, made = [], [], 0, made + 1
        if held:
            yield block()
        del encoder, held, ids
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(1024))  # deals equal rows out as well
    return rows.repartition(F.xxhash64("doc_id", "text", salt)).mapInArrow(encoded, BLOCKS)


def running(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of value over all earlier blocks (of the same keys), by way of the sums of whole parts."""
    of_part = df.groupBy("part", *keys).agg(F.sum(value).alias("part_sum"))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    of_part = of_part.select("part", *keys, F.coalesce(F.sum("part_sum").over(before), F.lit(0)).alias("part_at"))
    inside = Window.partitionBy("part", *keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    within = df.withColumn("in_part", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = within.part.eqNullSafe(of_part.part)
    for k in keys:
        same &= within[k].eqNullSafe(of_part[k])
    return within.join(of_part, same).select(*(within[c] for c in df.columns), (F.col("in_part") + F.col("part_at")).alias(name))


def starts(blocks: DataFrame, targets: dict[str | None, float] | None) -> DataFrame:
    """block, at (place of its first token), queues array<struct<source, share, deficit>>.

    Shares are the given targets, or each source's share of all tokens.
    """
    spark = blocks.sparkSession
    part = F.shiftright("block", 32)
    supply = blocks.select("block", F.inline("docs")).groupBy("block", "source").agg(F.sum("n").alias("n")).withColumn("part", part)
    place = running(supply.groupBy("block", "part").agg(F.sum("n").alias("n")), [], "n", "at").select("block", "at")
    if targets is None:
        share = supply.groupBy("source").agg(F.sum("n").alias("of_source"))
        share = share.crossJoin(F.broadcast(share.agg(F.sum("of_source").alias("of_all")))).select("source", (F.col("of_source") / F.col("of_all")).alias("share"))
    else:
        share = spark.createDataFrame(list(targets.items()), "source string, share double")
    sent = running(supply, ["source"], "n", "sent")
    sent = sent.join(share, sent.source.eqNullSafe(share.source), "left").select("block", sent.source, "sent", F.coalesce("share", F.lit(0.0)).alias("share"))
    queue = F.struct("source", "share", (F.col("share") * F.col("at") - F.col("sent")).alias("deficit"))
    return sent.join(place, "block").groupBy("block").agg(F.first("at").alias("at"), F.sort_array(F.collect_list(queue)).alias("queues"))


def rounds(docs: list[dict], queues: list[dict], at: int, window: int = WINDOW) -> Iterator[tuple[int, int, int, int]]:
    """(document's index, start, length, place) of each piece of a block, in order of places."""
    lines: dict[str | None, deque] = {q["source"]: deque() for q in queues}
    for i, d in enumerate(docs):
        lines[d["source"]].append([i, 0, d["n"]])
    left = {s: sum(x[2] for x in line) for s, line in lines.items()}
    deficit = {q["source"]: q["deficit"] for q in queues}
    share = {q["source"]: max(q["share"], 1e-9) for q in queues}
    order = [q["source"] for q in queues]
    while order:
        whole = sum(share[s] for s in order)
        #: Rounds in which nobody may send are passed over at once.
        wait = min((min(MIN_PIECE, left[s]) - deficit[s]) / (share[s] / whole * window) for s in order)
        turn = max(1, int(np.ceil(wait)))
        for s in list(order):
            deficit[s] += share[s] / whole * window * turn
            if deficit[s] < min(MIN_PIECE, left[s]):
                continue
            send = min(left[s], int(deficit[s]))
            if left[s] - send < MIN_PIECE:
                send = left[s]
            deficit[s] -= send
            left[s] -= send
            line = lines[s]
            while send:
                i, start, rest = line[0]
                n = min(send, rest, window - at % window)
                yield i, start, n, at
                send -= n
                at += n
                if n == rest:
                    line.popleft()
                else:
                    line[0] = [i, start + n, rest - n]
            if not left[s]:
                order.remove(s)


def pack(docs: DataFrame, path: str, targets: dict[str | None, float] | None = None) -> DataFrame:
    """Rows of PIECES: where each piece of each document lies."""
    work = Workspace(docs.sparkSession, "packing")
    blocks = work.table(encode_blocks(docs, path), "blocks")
    begin = work.table(starts(blocks, targets), "starts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]
        types = [pa.int64()] * 7 + [pa.string()]
        for batch in batches:
            for i in range(batch.num_rows):
                held, raw, at, queues = (batch.column(j)[i].as_py() for j in range(4))
                total = sum(d["n"] for d in held)
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * total else "<u4").astype("<u4")
                first = np.concatenate([[0], np.cumsum([d["n"] for d in held])])
                view, rows = memoryview(ids).cast("B"), []
                for k, start, n, place in rounds(held, queues, at):
                    x = 4 * (int(first[k]) + start)
                    d = held[k]
                    rows.append((d["doc_id"], start, n, zlib.crc32(view[x : x + 4 * n]), d["n"], place // WINDOW, place % WINDOW, d["source"]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return blocks.join(begin, "block").select("docs", "ids", "at", "queues").mapInArrow(cut, PIECES)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))
