"""SimHash near-duplicates found through per-segment bit counts.

A fingerprint's 32 two-bit segments are mapped to their bit counts (0, 1 or 2). The Manhattan
distance of two such vectors never exceeds the Hamming distance of the fingerprints, so every
linked pair is within `bits` of each other on that grid. The vector is cut into bits + 3 blocks;
within that distance at least three blocks must agree in full, so equal cells of some three blocks
retrieve every candidate. Candidates are then filtered by Manhattan distance (the unary code of the
counts makes it one xor and one popcount) and verified exactly by Hamming distance.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm.common import components, durable, small, table

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Rows of one cell that are compared within one task; larger cells are dealt out as pairs of shares.
SHARE = 4096
#: Rows held by a task at a time.
BLOCK = 1 << 18


def fingerprint(text: str | None, width: int = 4) -> int:
    """The SimHash of the word shingles of a text; 0 without words."""
    import xxhash

    words = text.encode().translate(LOWER).split() if text else []
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= width:
        return h(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - width] + 1).tolist()]
    hashes = np.array([h(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for block in range(0, len(hashes), 4096):
        raw = hashes[block : block + 4096].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, fp: fp holds the 64 bits as a signed long. Null text counts as empty."""

    def run(batches):
        for batch in small(batches):
            fp = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def block_masks(bits: int) -> list[int]:
    """For each choice of three of bits + 3 blocks of whole segments, the mask of their 64 bits."""
    n = bits + 3
    edges = [2 * (32 * i // n) for i in range(n + 1)]
    blocks = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(n)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(a | b | c) for a, b, c in combinations(blocks, 3)]


def _forest(cell, side, rep, fp, unary, bits: int):
    """Edges of a spanning forest of the links among rows of equal cells; rows are sorted by cell.

    side: 0 or 1 for rows of two shares that are compared with each other only, 2 for one share.
    """
    n = len(cell)
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out_u, out_v = [], []
    alive = np.arange(n - 1) if n else np.arange(0)
    step = 1
    while len(alive):
        alive = alive[alive + step < n]
        alive = alive[cell[alive] == cell[alive + step]]
        a, b = alive, alive + step
        apart = (side[a] == 2) | (side[a] != side[b])
        near = apart & (np.bitwise_count(unary[a] ^ unary[b]) <= bits)
        a, b = a[near], b[near]
        hit = np.bitwise_count(fp[a] ^ fp[b]) <= bits
        a, b = a[hit], b[hit]
        if len(a):
            new = root[a] != root[b]
            for i, j in zip(a[new].tolist(), b[new].tolist(), strict=True):
                i, j = find(i), find(j)
                if i != j:
                    root[max(i, j)] = min(i, j)
                    out_u.append(rep[i])
                    out_v.append(rep[j])
            while (up := root[root]).tobytes() != root.tobytes():
                root = up
        step += 1
    return out_u, out_v


def _whole_cells(batches):
    """Tables of whole cells of sorted batches, of BLOCK rows and a cell at most."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= BLOCK:
            got = pa.Table.from_batches(held)
            cell = got.column("cell").to_numpy()
            last = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on
            if last:
                yield got.slice(0, last)
            held, n = got.slice(last).to_batches(), n - last
    if n:
        yield pa.Table.from_batches(held)


def links(nodes: DataFrame, bits: int = 4) -> DataFrame:
    """nodes(rep long, fp long; fp distinct) -> (u, v): enough of the links within `bits` to span each component.

    Cells are dealt by hash and sorted; each task compares neighbours at growing distance within
    their cell, about BLOCK rows of whole cells at a time, and its output is at most one edge a row.
    A cell of more than SHARE rows is split into shares, every pair of which becomes a cell of its
    own: no cell is cut short.
    """
    # of a segment's two bits: low = either, high = both, which is its bit count in unary
    unary = "((fp | shiftrightunsigned(fp, 1)) & 6148914691236517205L) | (fp & shiftleft(fp, 1) & -6148914691236517206L)"
    masks = ", ".join(f"{m}L" if m != -(1 << 63) else "(-9223372036854775807L - 1L)" for m in block_masks(bits))
    rows = nodes.withColumn("unary", F.expr(unary)).select(
        "rep", "fp", "unary", F.posexplode(F.expr(f"array({masks})")).alias("choice", "mask")
    )
    rows = rows.select(F.expr("xxhash64(choice, unary & mask)").alias("cell"), "rep", "fp", "unary")
    large = (
        rows.groupBy("cell").count().where(F.col("count") > SHARE)
        .select(F.col("cell").alias("large"), F.ceil(F.col("count") / SHARE).cast("int").alias("shares"))
    )
    large = durable(large)
    dealt = rows.withColumn("side", F.lit(2).cast("byte"))
    if not large.isEmpty():
        joined = rows.join(large, F.col("cell") == F.col("large"), "left").withColumn("own", F.expr("cast(pmod(xxhash64(fp, 7), shares) as int)"))
        small = joined.where("large is null").select("cell", "rep", "fp", "unary", F.lit(2).cast("byte").alias("side"))
        other = joined.where("large is not null").withColumn("other", F.explode(F.expr("sequence(0, shares - 1)")))
        split = other.select(
            F.expr("xxhash64(cell, least(own, other), greatest(own, other), 11)").alias("cell"), "rep", "fp", "unary",
            F.expr("cast(case when own = other then 2 when own < other then 0 else 1 end as byte)").alias("side"),
        )
        dealt = small.union(split)

    def run(batches):
        for got in _whole_cells(batches):
            number = lambda name, got=got: got.column(name).to_numpy()
            u, v = _forest(number("cell"), number("side"), number("rep"), number("fp").view(np.uint64), number("unary").view(np.uint64), bits)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, bits: int = 4, width: int = 4) -> DataFrame:
    """doc_id, fingerprint, component_id: one row per row of docs.

    Fingerprints within `bits` bits are linked, equal ones included, whatever they stand for: texts
    without words (null, empty, white space) have fingerprint zero and are linked with each other
    and with what lies near zero. component_id is the smallest doc_id reachable. Rows that repeat
    are returned as often as they occur; a null doc_id is linked like any other and never chosen as
    component_id unless all are null; extra columns are ignored; an empty table gives no rows.
    """
    prints = durable(fingerprints(docs, width))
    # a class of equal fingerprints is one node, named by its smallest doc_id
    nodes = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = components(links(nodes.where("rep is not null"), bits))
    labelled = nodes.join(roots, nodes["rep"] == roots["node"], "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return prints.join(labelled, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
