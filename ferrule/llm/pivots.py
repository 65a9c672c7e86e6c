"""Near-duplicate vectors by a pivot-permutation index.

Reference points (pivots) are picked from a bounded sample so that no two are alike. Each vector is
described by its KEEP nearest pivots in order; inverted lists hold the vectors by pivot, and the
candidates for a pair are those found in two lists at least (a shared-pivot count of two). The lists
are kept by pairs of pivots, so that count needs no join of whole lists. Candidates are verified by
cosine in double precision; a pair found in several lists counts in the first only.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm.common import components, durable, table

PIVOTS, KEEP, SAMPLE, ALIKE = 512, 8, 4096, 0.6
#: Rows of one list compared within one task; longer lists are dealt out as pairs of shares.
SHARE = 4096


def unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow of squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def choose(sample: np.ndarray, pivots: int = PIVOTS, alike: float = ALIKE) -> np.ndarray:
    """Rows of the sample in its order, none of a cosine of `alike` or more to one taken before."""
    out = np.zeros((0, sample.shape[1] if sample.ndim == 2 else 0))
    for x in sample:
        if len(out) == pivots:
            break
        if not len(out) or (out @ x).max() < alike:
            out = np.vstack([out, x])
    return out


def describe(nodes: DataFrame, pivots: dict[int, np.ndarray], keep: int = KEEP) -> DataFrame:
    """rep, copies, raw (little-endian doubles), order (16-bit pivots, nearest first), lists array<long>.

    pivots: by the length of vectors, since only vectors of one length are compared; a list's number holds that length.
    Vectors of a length without pivots share one list.
    """
    held = nodes.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        for batch in batches:
            size = np.array([len(b) for b in batch.column(1).to_pylist()], np.int64)
            for n in np.unique(size).tolist():
                own = batch.filter(pa.array(size == n))
                p, rows = held.value.get(n // 8), own.num_rows
                k = min(keep, 0 if p is None else len(p))
                if k:
                    raw = np.frombuffer(b"".join(own.column(1).to_pylist()), "<f8").reshape(rows, -1)
                    cuts = np.array(list(combinations(range(k), min(2, k))), np.int64)
                    order = np.argsort(-(unit(raw) @ p.T), axis=1, kind="stable")[:, :k]
                    pairs = np.sort(order[:, cuts], axis=2)
                    lists = (pairs[:, :, 0] << 16) + (pairs[:, :, 1] if k > 1 else 0)
                else:
                    order, lists = np.zeros((rows, 0), np.int64), np.full((rows, 1), (1 << 32) - 1, np.int64)
                lists = lists + (n << 32)
                flat = pa.ListArray.from_arrays(np.arange(rows + 1, dtype=np.int32) * lists.shape[1], pa.array(lists.ravel()))
                orders = pa.array([o.astype("<u2").tobytes() for o in order], pa.binary())
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(2), own.column(1), orders, flat], ["rep", "copies", "raw", "order", "lists"])

    return nodes.select("rep", "raw", "copies").mapInArrow(run, "rep long, copies long, raw binary, order binary, lists array<long>")


def _compare(block_a, block_b, same: bool, cosine: float):
    """Positions (i, j) of pairs at or above the cosine."""
    sims = block_a @ block_b.T
    i, j = np.nonzero(sims >= cosine)
    if same:
        i, j = i[i < j], j[i < j]
    return i, j


def found_links(described: DataFrame, cosine: float) -> DataFrame:
    """u, v, n: rows with v null say that u has links to n vectors; the others are edges that span each list's links."""
    rows = described.select("rep", "copies", "raw", "order", F.explode("lists").alias("list"))
    rows = rows.withColumns({"lo": F.lit(0), "hi": F.lit(0), "side": F.lit(2).cast("byte")})
    large = rows.groupBy("list").count().where(F.col("count") > SHARE)
    large = durable(large.select(F.col("list").alias("long_list"), F.ceil(F.col("count") / SHARE).cast("int").alias("shares")))
    if not large.isEmpty():
        joined = rows.join(large, F.col("list") == F.col("long_list"), "left").withColumn("own", F.expr("cast(pmod(xxhash64(rep, 7), shares) as int)"))
        other = joined.where("long_list is not null").withColumn("other", F.explode(F.expr("sequence(0, shares - 1)")))
        split = other.withColumns({
            "lo": F.least("own", "other"), "hi": F.greatest("own", "other"),
            "side": F.expr("cast(case when own = other then 2 when own < other then 0 else 1 end as byte)"),
        })
        rows = joined.where("long_list is null").select(*rows.columns).union(split.select(*rows.columns))

    def run(batches):
        cells = _cells(batches)
        degree: dict[int, int] = {}
        for lists, side, rep, copies, raw, order in cells:
            x = unit(raw)
            a = np.flatnonzero(side != 1)
            b = a if side[0] == 2 else np.flatnonzero(side == 1)
            root = np.arange(len(rep))
            u, v = [], []
            for i0 in range(0, len(a), 512):
                for j0 in range(0 if a is not b else i0, len(b), 512):
                    ia, jb = a[i0 : i0 + 512], b[j0 : j0 + 512]
                    i, j = _compare(x[ia], x[jb], a is b and i0 == j0, cosine)
                    i, j = ia[i], jb[j]
                    if not len(i):
                        continue
                    oi, oj, at = np.sort(order[i], axis=1), order[j], np.arange(len(i))
                    if order.shape[1]:
                        shared = (oi[:, :, None] == oj[:, None, :]).any(axis=2)
                        first = shared.argmax(axis=1)
                        rest = shared.copy()
                        rest[at, first] = False
                        second = oi[at, rest.argmax(axis=1)] if order.shape[1] > 1 else 0
                    own = (oi[at, first] << 16) + second == lists & 0xFFFFFFFF if order.shape[1] else np.ones(len(i), bool)
                    i, j = i[own], j[own]
                    for k, n in zip(*_sums(i, copies[j]), strict=True):
                        degree[int(rep[k])] = degree.get(int(rep[k]), 0) + int(n)
                    for k, n in zip(*_sums(j, copies[i]), strict=True):
                        degree[int(rep[k])] = degree.get(int(rep[k]), 0) + int(n)
                    new = root[i] != root[j]
                    for p, q in zip(i[new].tolist(), j[new].tolist(), strict=True):
                        p, q = root[p], root[q]
                        if p != q:
                            root[root == max(p, q)] = min(p, q)
                            u.append(int(rep[p]))
                            v.append(int(rep[q]))
            if u:
                yield _batch(u, v, [0] * len(u))
            if len(degree) > 100_000:
                yield _batch(list(degree), [None] * len(degree), list(degree.values()))
                degree = {}
        yield _batch(list(degree), [None] * len(degree), list(degree.values()))

    dealt = rows.select("list", "lo", "hi", "side", "rep", "copies", "raw", "order").repartition("list", "lo", "hi").sortWithinPartitions("list", "lo", "hi")
    return dealt.mapInArrow(run, "u long, v long, n long")


def _batch(u, v, n):
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (u, v, n)], ["u", "v", "n"])


def _sums(at: np.ndarray, n: np.ndarray):
    keys, inverse = np.unique(at, return_inverse=True)
    return keys.tolist(), np.bincount(inverse, weights=n).astype(np.int64).tolist()


def _cells(batches):
    """Runs of equal cells of sorted batches: at most 2 x SHARE rows are held, plus one batch."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        if not held.num_rows:
            continue
        new = np.any([np.diff(held.column(c).to_numpy()) != 0 for c in ("list", "lo", "hi")], axis=0)
        edges = [0, *(np.flatnonzero(new) + 1).tolist()]
        yield from (_arrays(held.slice(a, b - a)) for a, b in zip(edges, edges[1:], strict=False) if b - a > 1)
        held = held.slice(edges[-1])
    if held is not None and held.num_rows > 1:
        yield _arrays(held)


def _arrays(t: pa.Table):
    number = lambda n: t.column(n).to_numpy()
    raw = np.frombuffer(b"".join(t.column("raw").to_pylist()), "<f8").reshape(t.num_rows, -1)
    order = np.frombuffer(b"".join(t.column("order").to_pylist()), "<u2")
    order = order.reshape(t.num_rows, len(order) // t.num_rows).astype(np.int64)
    return int(t.column("list")[0].as_py()), number("side"), number("rep"), number("copies"), raw, order


def vectors(table_: DataFrame, key: str, column: str) -> DataFrame:
    """vec_id, raw: components as little-endian doubles; null if the vector may link with nothing."""

    def run(batches):
        for batch in batches:
            out = []
            for x in batch.column(1).to_pylist():
                v = np.array(x, np.float64) if x and None not in x else None
                ok = v is not None and np.isfinite(v).all() and v.any()
                out.append((v + 0.0).astype("<f8").tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "raw"])

    return table_.select(F.col(key).cast("long"), column).mapInArrow(run, "vec_id long, raw binary")


def near_vectors(embeddings: DataFrame, cosine: float = 0.9, key: str = "vec_id", column: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of embeddings.

    Equal vectors are one node with its number of copies, linked with each other. Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing, and those of different
    lengths not with each other. vec_id is the key: repeated rows count as copies of each other; a null vec_id is
    returned, unlinked. Extra columns are ignored; an empty table gives no rows. The pivots come from
    the SAMPLE vectors with the smallest hash of their id; every vector is indexed.
    """
    rows = durable(vectors(embeddings, key, column))
    good = rows.where("raw is not null and vec_id is not null")
    nodes = durable(good.groupBy("raw").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    sample = [bytes(r[0]) for r in nodes.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("raw").collect()]
    by_size = {n: [b for b in sample if len(b) == n] for n in {len(b) for b in sample}}
    chosen = {n // 8: choose(unit(np.array([np.frombuffer(b, "<f8") for b in own])), pivots) for n, own in by_size.items()}
    links = durable(found_links(describe(nodes, chosen), cosine))
    degree = links.where("v is null").groupBy("u").agg(F.sum("n").alias("n"))
    roots = components(links.where("v is not null").select("u", "v"))
    known = nodes.join(degree, nodes["rep"] == degree["u"], "left").join(roots, nodes["rep"] == roots["node"], "left").select(
        F.col("raw").alias("r"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id")
    )
    linked = F.when(F.col("vec_id").isNotNull(), F.col("raw"))
    return rows.join(known, linked == known["r"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.coalesce("component_id", "vec_id")).alias("kept"),
    )


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
