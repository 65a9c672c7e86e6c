"""Packing token sequences by the histogram of their lengths, shortest pack first."""

from __future__ import annotations

import heapq
import zlib
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.llm.common import durable, small, table

CAPACITY = 2048
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long"
)


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Shortest-pack-first: [(how many sequences, their lengths in order)].

    Lengths are placed longest first, each into the pack filled least so far; packs of one
    pattern are kept as a count, so the work depends on the number of lengths, not of documents.
    A length above the capacity or not positive is an error; no lengths give no packs.
    """
    if any(not 0 < n <= capacity for n in histogram):
        raise ValueError("lengths must be in 1..capacity")
    fill: list[tuple[int, int, tuple[int, ...]]] = []  # heap of (filled, number, pattern)
    count: Counter = Counter()
    full: Counter = Counter()
    number = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while fill and not count[fill[0][2]]:
                heapq.heappop(fill)
            filled, pattern = (fill[0][0], fill[0][2]) if fill and fill[0][0] + length <= capacity else (0, ())
            n = left
            if pattern:
                n = min(left, count[pattern])
                count[pattern] -= n
            pattern = (*pattern, length)
            left -= n
            if filled + length == capacity:
                full[pattern] += n
            elif count[pattern]:
                count[pattern] += n
            else:
                count[pattern] = n
                number += 1
                heapq.heappush(fill, (filled + length, number, pattern))
    return [(n, list(p)) for p, n in sorted((full + count).items(), reverse=True)]


def slots(patterns: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank + 1, first sequence, offset): which ranks of a length lie where."""
    rank: Counter = Counter()
    out, sequence = [], 0
    for n, lengths in patterns:
        at = 0
        for length in lengths:
            out.append((length, rank[length], rank[length] + n, sequence, at))
            rank[length] += n
            at += length
        sequence += n
    return out


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: whole sequences first, then the rest of each document.

    `nth` numbers the pieces of one length within one task (`part`), so that ranks over the whole
    table need only the tasks' histograms. Null text counts as empty: just the end id.
    """

    def cut(batches):
        from ferrule.llm.tokens import WordBpe

        bpe = _worker(tokenizer, WordBpe)
        part, seen, end = TaskContext.get().partitionId(), Counter(), end_id.to_bytes(4, "little")
        for batch in small(batches):
            rows = []
            every, ends = bpe.encode_column(batch.column(1))
            for i, doc in enumerate(batch.column(0).to_pylist()):
                ids = every[ends[i] : ends[i + 1]].tobytes() + end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    own = ids[4 * start : 4 * (start + capacity)]
                    rows.append((doc, start, len(own) // 4, zlib.crc32(own), n, part, seen[len(own) // 4]))
                    seen[len(own) // 4] += 1
            columns = zip(*rows) if rows else [()] * 7
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"],
            )
        bpe.forget()  # the worker may serve other operators next

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


_BPE: dict = {}


def _worker(path, kind, *args):
    """One tokenizer for each Python worker."""
    if path not in _BPE:
        _BPE[path] = kind(path, *args)
    return _BPE[path]


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Packs every document's tokens and its end id into sequences of at most `capacity` ids.

    docs(doc_id, text, ...) -> doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    padded_to. Null and empty texts give one piece (the end id), repeated rows are packed as often
    as they occur, a null doc_id is carried along, other columns are ignored, no documents give
    no rows. The driver sees the histogram only: at most `capacity` lengths.
    """
    spark = docs.sparkSession
    pieces = durable(token_pieces(docs, tokenizer, end_id, capacity))
    by_part = pieces.groupBy("length", "part").agg((F.max("nth") + 1).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r[0]: r[1] for r in by_part.groupBy("length").agg(F.sum("n")).collect()}
    where = slots(pack_histogram(histogram, capacity))
    total = Counter()
    for length, lo, hi, first, _ in where:
        total[first, hi - lo] += length
    rows = [(n, lo, hi, first, at, total[first, hi - lo]) for n, lo, hi, first, at in where]
    places = spark.createDataFrame(
        rows, "s_length long, lo long, hi long, first long, offset long, filled long"
    )
    ranked = pieces.join(base, ["length", "part"]).withColumn("rank", F.col("nth") + F.col("base"))
    at = (ranked["length"] == places["s_length"]) & (ranked["rank"] >= places["lo"]) & (ranked["rank"] < places["hi"])
    # the places number at most a few per length, whatever the corpus
    return ranked.join(F.broadcast(places), at).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset",
        F.when(F.col("filled").bitwiseAND(F.col("filled") - 1) == 0, F.col("filled")).otherwise(capacity).alias("padded_to"),
    )


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
