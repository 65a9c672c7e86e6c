"""What the corpus operators share: durable intermediate tables, generation caches, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows and bytes of an Arrow batch at most: a batch is held in the JVM's buffers and again in the Python worker.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1024, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's limits of Arrow batches to BATCH; lower ones stay. Results don't depend on them."""
    for key, most in BATCH.items():
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one named by spark.checkpoint.dir.

    Where none is set, a temporary one is picked if driver and executors are one process (tests, a laptop);
    on a cluster it is an error.
    """
    bound_batches(spark)
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ferrule-ckpt-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and cuts its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def dropped(spark: SparkSession) -> None:
    """Has Spark's cleaner see which shuffles nothing refers to any more, so that their files go before the next ones come."""
    gc.collect()
    spark._jvm.System.gc()


class Scratch:
    """Tables of its own in the shared folder, until drop().

    Unlike a checkpoint, whose estimated size is that of the plan behind it, a written table has the size it has: in
    a loop of joins the estimates of checkpoints multiply until planning takes longer than the work.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows, of under 64 bytes each, that are broadcast at most.
SMALL = 20_000


def sized(df: DataFrame) -> DataFrame:
    """A durable table of small rows, to be broadcast if it has SMALL rows at most and joined by a shuffle otherwise."""
    return F.broadcast(df) if df.count() <= SMALL else df


def small(batches, rows: int = 512):
    """Arrow batches cut to few rows, so that a task turns a part of a batch into Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class Memo:
    """A memo of a function from a list of strings to the list of their values, asked for many keys at a time.

    Memory is bounded: two generations of about `size` entries each, of which the older one goes when the younger is
    full, and keys of `longest` characters on are never kept. Only speed depends on the bounds, never a result.
    """

    def __init__(self, f: Callable[[list], list], size: int, longest: int = 1_000):
        self.f, self.size, self.longest, self.young, self.old = f, size, longest, {}, {}

    def forget(self) -> None:
        self.young, self.old = {}, {}

    def __call__(self, keys: list) -> list:
        out = list(map(self.young.get, keys))
        if None not in out:
            return out
        extra, fresh = {}, []
        for k in {k for k, v in zip(keys, out, strict=True) if v is None}:
            v = self.old.get(k)
            if v is None:
                fresh.append(k)
            else:
                extra[k] = v
        extra.update(zip(fresh, self.f(fresh), strict=True))
        out = [extra[k] if v is None else v for k, v in zip(keys, out, strict=True)]
        if len(self.young) + len(extra) > self.size:
            self.old, self.young = self.young, {}
        self.young.update((k, v) for k, v in extra.items() if len(k) < self.longest)
        return out


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    edges(u long, v long) -> (node long, root long), root being the smallest node reachable;
    only nodes with an edge to another node are returned. Self-loops, repeated and reversed
    edges and an empty table are fine; edges with a null end are ignored. Every step is a
    partial aggregation plus an equi-join, so a hub of any degree is spread by AQE, and each
    step's edges are written to the checkpoint folder.
    """
    e = (
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v"))
        .distinct()
    )
    e = durable(e)
    seen = None
    for _ in range(rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = durable(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        mark = e.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38, 0)))"), F.count_distinct("u")).head()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    pairs = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return pairs.union(pairs.select(F.col("root").alias("node"), "root").distinct())
