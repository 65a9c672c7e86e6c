"""Byte-level BPE: encoding whole texts to ids and decoding ids to bytes, over Arrow batches."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ferrule.llm.common import small, table

_BPE: dict = {}


def _bpe(path: str, pattern: str):
    from ferrule.llm.tokens import ByteBpe

    if (path, pattern) not in _BPE:
        _BPE[path, pattern] = ByteBpe(path, pattern)
    return _BPE[path, pattern]


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def encode(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids array<int>, starts array<int>, ends array<int>: each id with its characters in the text.

    An id that begins or ends inside a character covers the whole character, so the spans of
    neighbouring ids may share one. Null and empty texts give empty arrays; repeated rows are
    encoded again; other columns are ignored; lone surrogates can't occur in Spark strings.
    """
    kind = docs.schema[key].dataType

    def run(batches):
        bpe = _bpe(ranks, pattern)
        for batch in small(batches):
            texts = batch.column(1).to_pylist()
            spans = [list(zip(*bpe.offsets(t or ""), strict=True)) or [(), (), ()] for t in texts]
            arrays = [pa.array([s[i] for s in spans], pa.list_(pa.int32())) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], [key, "ids", "starts", "ends"])

    fields = [T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("ids", "starts", "ends")]
    return docs.select(key, text).mapInArrow(run, T.StructType([T.StructField(key, kind), *fields]))


def decode(ids: DataFrame, ranks: str, pattern: str, key: str = "doc_id", column: str = "ids") -> DataFrame:
    """key, bytes binary, text string: the byte table reversed.

    A character split over several ids is whole again once their bytes are joined; bytes that are no
    UTF-8 (ids cut off inside a character) are shown as U+FFFD in `text` and kept in `bytes`. A null
    array decodes to null, an empty one to empty bytes, an unknown or null id is an error.
    """
    kind = ids.schema[key].dataType

    def run(batches):
        bpe = _bpe(ranks, pattern)
        for batch in small(batches):
            raw = [None if a is None else bpe.decode(a) for a in batch.column(1).to_pylist()]
            text = [None if b is None else b.decode("utf-8", "replace") for b in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array(text, pa.string())], [key, "bytes", "text"])

    fields = [T.StructField("bytes", T.BinaryType()), T.StructField("text", T.StringType())]
    return ids.select(key, column).mapInArrow(run, T.StructType([T.StructField(key, kind), *fields]))


def digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode, then decode the ids, keeping digests only.

    Null and empty texts have no tokens and the digests of nothing. Memory: one text and a bounded memo.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        bpe = _bpe(ranks, pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in small(batches):
            rows = []
            for doc, ids, raw in zip(batch.column(0).to_pylist(), *bpe.encode_column(batch.column(1)), strict=True):
                rows.append((doc, ids.count(",") + 1 if ids else 0, sha(ids.encode()), sha(raw)))
            yield _arrow(rows, schema)
        bpe.forget()  # the worker may serve other operators next

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
