"""Queries of the training-data operators and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chainloom.llm.chat_format import OP4_SQL, op4_chat_format
from chainloom.llm.class_lm import op10_class_lm
from chainloom.llm.decontam import op7_decontam
from chainloom.llm.language_id import op2_language_id
from chainloom.llm.media_columns import op3_media_columns
from chainloom.llm.minhash_dedup import OP1_SQL, op1_minhash_dedup
from chainloom.llm.packing import op8_packing
from chainloom.llm.pii import op5_pii
from chainloom.llm.token_counts import op9_token_counts
from chainloom.llm.warc import OP6_SQL, op6_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_dedup": op1_minhash_dedup,
        "op2_language_id": op2_language_id,
        "op3_media_columns": op3_media_columns,
        "op4_chat_format": op4_chat_format,
        "op5_pii": op5_pii,
        "op6_warc": op6_warc,
        "op7_decontam": op7_decontam,
        "op8_packing": op8_packing,
        "op9_token_counts": op9_token_counts,
        "op10_class_lm": op10_class_lm,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash_dedup": OP1_SQL,
        "op4_chat_format": OP4_SQL,
        "op6_warc": OP6_SQL,
    }
