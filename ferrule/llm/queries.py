"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ferrule.llm import bpe, hmm, images, langid, lines, packing, passages, pii, pivots, simhash

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": packing.op1_packing,
    "op2_pii": pii.op2_pii,
    "op3_embedding_dedup": pivots.op3_embedding_dedup,
    "op4_image_copies": images.op4_image_copies,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op6_line_dedup": lines.op6_line_dedup,
    "op7_language_id": langid.op7_language_id,
    "op8_passages": passages.op8_passages,
    "op9_hmm": hmm.op9_hmm,
    "op10_simhash": simhash.op10_simhash,
}

ORACLE_SQL: dict[str, str] = {"op6_line_dedup": lines.OP6_SQL}
