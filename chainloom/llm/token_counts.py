"""Operator 9: token counts by batch encoding in Arrow functions that return lengths only.

Texts are cut at safe boundaries, whatever their length: single spaces between two characters that aren't white space.
The byte-level pre-tokeniser takes such a space only at the start of a piece and never looks back, and a sentencepiece
vocabulary without pieces across spaces puts a space's sign before each piece by itself, so the pieces' lengths add up to
the text's. What a vocabulary relies on is tested; with another one, texts stay whole. The different pieces of some
megabytes of rows go to the library in batches balanced by bytes, each once, and its lengths are summed up by row. Texts
and ids never leave the worker, only two numbers a row do.

Defined results: a null or empty text has 0 bytes and 0 tokens; a null doc_id stays null; repeated rows each give a
row; a very long text is cut like others, and one without safe boundaries is one piece; an empty table gives no rows;
columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.llm.common import documents, give_back

SAFE = re.compile("(?<=[^\\s\u2581]) (?=[^\\s\u2581])")  # U+2581 is sentencepiece's sign of a space
BATCH_BYTES = 1 << 18  # of different pieces that go to the library at once
WINDOW = 8 << 20  # bytes of texts whose pieces are told apart together
LIMIT = 512

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def members(*values: int) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


BLANK = members(*range(9, 14), *range(28, 33))  # ASCII white space, the separators included
WIDE = members(0xC2, 0xE1, 0xE2, 0xE3)  # first bytes of other characters that may be white space
LETTER = members(*range(0xC3, 0xE0))  # first bytes of two-byte characters, none of which is


def boundaries(data: np.ndarray) -> np.ndarray:
    """Places of spaces in UTF-8 bytes that have certainly no white space beside them."""
    at = np.flatnonzero(data[1:-1] == 32) + 1
    before, after = data[at - 1], data[at + 1]
    clear = (before < 128) & ~BLANK[before] | (before >= 128) & LETTER[data[np.maximum(at - 2, 0)]]
    return at[clear & ~BLANK[after] & ~WIDE[after]]


class Encoder:
    """Lengths for a .json (tokenizers) or .model (sentencepiece) vocabulary."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.bytes_kept = path.endswith(".json")  # a piece keeps the space it begins with
        if self.bytes_kept:
            from tokenizers import Tokenizer

            self.tok = Tokenizer.from_file(path)
            self.tok.no_truncation()
            self.tok.no_padding()
            said = json.loads(self.tok.to_str())
            cut = said.get("pre_tokenizer") or {}
            added = [t for t in said["added_tokens"] if " " in t["content"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
            self.splits = (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex")) == ("ByteLevel", False, True) and not said.get("normalizer") and not added
        else:
            import sentencepiece

            self.tok = sentencepiece.SentencePieceProcessor(model_file=path)
            inside = re.compile("[^\u2581]\u2581")
            across = any(inside.search(self.tok.id_to_piece(i)) for i in range(self.tok.get_piece_size()))
            self.splits = not across and self.tok.encode("b", out_type=str)[0].startswith("\u2581")

    def lengths(self, pieces: list[str]) -> np.ndarray:
        """Lengths of different pieces, encoded in batches of like bytes."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        batch = np.cumsum(sizes) // BATCH_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(batch)) + 1).tolist(), len(pieces)]
        out = []
        for at, end in zip(cuts[:-1], cuts[1:], strict=True):
            part = pieces[at:end]
            out += [len(x) for x in (self.tok.encode_batch_fast(part, add_special_tokens=False) if self.bytes_kept else self.tok.encode(part, num_threads=1))]
        return np.array(out, np.int64)

    def by_bytes(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Counts of texts that lie one after the other in data, the first at 0, ends being where each one ends."""
        starts = np.concatenate([[0], ends[:-1]])
        cuts = np.union1d(boundaries(data) if len(data) > 2 else np.empty(0, np.int64), starts[starts < len(data)]).astype(np.int64)
        offsets = np.append(cuts, len(data)).astype(np.int64)
        pieces = pa.LargeStringArray.from_buffers(len(cuts), pa.py_buffer(offsets), pa.py_buffer(data))
        coded = pieces.dictionary_encode()
        n = self.lengths(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        below = np.concatenate([[0], np.cumsum(n)])
        return below[np.searchsorted(cuts, ends)] - below[np.searchsorted(cuts, starts)]

    def by_text(self, texts: list[str]) -> np.ndarray:
        """Counts of texts whose pieces lose the space at which they are cut, or of whole texts."""
        cut = [SAFE.split(t) if self.splits and t else [t] for t in texts]
        once = list(dict.fromkeys(p for pieces in cut for p in pieces if p))
        known = dict(zip(once, self.lengths(once).tolist(), strict=True))
        return np.array([sum(known[p] for p in pieces if p) for pieces in cut], np.int64)

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text, null being empty. Rows are taken together up to WINDOW bytes; longer ones are cut."""
        texts = texts.cast(pa.large_string()).fill_null("")
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.empty(0, np.uint8)
        out, first = [], 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + WINDOW, "right")) - 1)
            part = data[ends[first] : ends[last]]
            if not (self.bytes_kept and self.splits):
                out.append(self.by_text(texts.slice(first, last - first).to_pylist()))
            elif len(part) <= WINDOW:
                out.append(self.by_bytes(part, ends[first + 1 : last + 1] - ends[first]))
            else:
                out.append(np.array([self.long(part)]))
            first = last
        return np.concatenate(out) if out else np.empty(0, np.int64)

    def long(self, data: np.ndarray) -> int:
        """Tokens of one text beyond WINDOW bytes, window by window, each of which ends at a safe boundary."""
        total, at = 0, 0
        while at < len(data):
            end, reach = len(data), at + WINDOW
            while reach < len(data):  # the last boundary of a window, or the first one beyond it
                found = boundaries(data[at:reach])
                if len(found):
                    end = at + int(found[-1])
                    break
                reach += WINDOW
            part = data[at:end]
            total += int(self.by_bytes(part, np.array([len(part)]))[0])
            at = end
        return total


def count_tokens(docs: DataFrame, vocabulary_path: str, limit: int = LIMIT) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary_path)
        for batch in batches:
            n = encoder.counts(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])
        give_back()

    size = F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), size.alias("size")).mapInArrow(counted, SCHEMA)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))
