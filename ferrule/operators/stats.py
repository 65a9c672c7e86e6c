"""Statistics over results, metrics, caches and parsed logs, each one grouped aggregation or ordered fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Promotion and health thresholds.
L2_AT, L1_AT = 5, 20
NON_HEAP_MB, LOADERS, HIT_RATE, MIN_REQUESTS, PAUSE_MS = 250, 50, 0.40, 20, 100.0


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def executor_metrics(results: DataFrame, success: str = "success", nanos: str | None = None) -> DataFrame:
    """total, succeeded, failed (and total and average time, 0 when there is none)."""
    ok = F.count_if(F.col(success))
    out = [F.count("*").alias("total"), ok.alias("succeeded"), F.count_if(~F.col(success)).alias("failed")]
    if nanos:
        out += [F.coalesce(F.sum(nanos), F.lit(0)).alias("total_nanos"), F.coalesce(F.avg(nanos), F.lit(0.0)).alias("avg_nanos")]
    return results.agg(*out)


def percentiles(samples: DataFrame, value: str, by: tuple[str, ...] = (), ps: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Exact, linearly interpolated percentiles named p50, p95, ...; 0 without samples. No sampling and no sort of the whole."""
    exprs = [F.coalesce(F.percentile(value, p), F.lit(0.0)).alias(f"p{round(p * 100)}") for p in ps]
    return samples.groupBy(*by).agg(*exprs) if by else samples.agg(*exprs)


def last_n(rows: DataFrame, n: int, order: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """The newest n rows (of each group): a bounded history that drops the oldest."""
    if n <= 0:
        raise ValueError("a history needs a positive capacity")
    newest = [F.desc(c) for c in order]
    if not by:
        return rows.orderBy(*newest).limit(n)
    w = Window.partitionBy(*by).orderBy(*newest)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def cache_stats(events: DataFrame) -> DataFrame:
    """events(op HIT/MISS/PUT/EVICT/PROMOTE/DEMOTE, tier) -> counts by kind and the hit rate."""
    of = lambda op, tier=None: F.count_if((F.col("op") == op) & (F.lit(True) if tier is None else F.col("tier") == tier))
    hits, misses = of("HIT"), of("MISS")
    return events.agg(
        of("HIT", "L1").alias("l1_hits"), of("HIT", "L2").alias("l2_hits"), of("HIT", "L3").alias("l3_hits"), misses.alias("misses"),
        of("PROMOTE").alias("promotions"), of("DEMOTE").alias("demotions"), of("EVICT").alias("evictions"), hits.alias("total_hits"),
        (hits + misses).alias("total_requests"), ratio(hits, hits + misses).alias("hit_rate"),
    )


def cache_promotions(accesses: DataFrame, key: str, order: list[str], start: str = "L3", by_count: tuple[int, int] = (L2_AT, L1_AT)) -> DataFrame:
    """Each access with the tier that serves it: a key's n-th access promotes it to L2 at 5 and to L1 at 20.

    Accesses are counted by key over all tiers; a promoted entry serves from its new tier at the next access.
    """
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    l2, l1 = by_count
    tier = F.when(F.col("n") > l1, "L1").when(F.col("n") > l2, "L2").otherwise(start if start != "L2" else "L2")
    return accesses.withColumn("n", n).withColumn("tier", tier).withColumn("promoted", (F.col("n") == l1) | ((F.col("n") == l2) & F.lit(start == "L3")))


def gc_stats(events: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    zero = lambda c, z=0.0: F.coalesce(c, F.lit(z))
    full = F.count_if("is_full")
    out = [
        F.count("*").alias("total_collections"), full.alias("full_gc"), (F.count("*") - full).alias("young_gc"), zero(F.sum("pause_ms")).alias("total_pause_ms"),
        zero(F.max("pause_ms")).alias("max_pause_ms"), zero(F.avg("pause_ms")).alias("avg_pause_ms"), zero(F.sum("reclaimed_kb"), 0).alias("reclaimed_kb"),
    ]
    return events.groupBy(*by).agg(*out) if by else events.agg(*out)


def throughput(pause_ms: Column, uptime_ms: Column) -> Column:
    """Percent of the uptime outside pauses."""
    return F.when(uptime_ms <= 0, 100.0).otherwise(F.greatest(F.lit(0.0), uptime_ms - pause_ms) / uptime_ms * 100.0)


def jit_stats(events: DataFrame) -> DataFrame:
    tiers = [F.count_if(F.col("tier") == t).alias(f"tier{t}") for t in (1, 2, 3, 4)]
    return events.agg(
        F.count("*").alias("total"), *tiers, F.count_if(F.col("tier") < 4).alias("c1"), F.coalesce(F.sum("bytecode_size"), F.lit(0)).alias("total_bytecode"),
        F.coalesce(F.avg("bytecode_size"), F.lit(0.0)).alias("avg_bytecode"), F.count_if("is_deopt").alias("deopts"), F.count_if("is_osr").alias("osr"),
    )


def current_tier(events: DataFrame, order: str, method: str = "method") -> DataFrame:
    """method, current_tier, is_c2, compilations: a deoptimisation resets to 0, else the highest tier since.

    Partial aggregates only: the last deoptimisation of each method, then the highest tier after it.
    """
    last = events.where("is_deopt").groupBy(method).agg(F.max(order).alias("_reset"))
    after = events.join(last, method, "left")
    tier = F.coalesce(F.max(F.when(F.col("_reset").isNull() | (F.col(order) > F.col("_reset")), F.col("tier"))), F.lit(0))
    return after.groupBy(method).agg(tier.alias("current_tier"), F.count("*").alias("compilations")).withColumn("is_c2", F.col("current_tier") == 4)


def flame_shares(stacks: DataFrame, floor: float = 5.0) -> DataFrame:
    """stacks plus percent of all samples and the bar width: at least `floor` percent."""
    total = stacks.agg(F.sum("count").alias("_total"))
    share = 100.0 * F.col("count") / F.col("_total")
    return stacks.crossJoin(F.broadcast(total)).withColumns({"percent": share, "width": F.greatest(F.lit(floor), share)}).drop("_total")


def profile_diff(a: DataFrame, b: DataFrame, order: str = "line_no") -> DataFrame:
    """stack, count_a, count_b, delta, percent, kind; of a stack that repeats in a profile the last line counts."""
    one = lambda p, n: p.groupBy("stack").agg(F.max_by("count", order).alias(n))
    x, y, d = F.col("count_a"), F.col("count_b"), F.col("count_b") - F.col("count_a")
    both = one(a, "count_a").join(one(b, "count_b"), "stack", "full_outer").na.fill(0, ["count_a", "count_b"])
    return both.select(
        "stack", "count_a", "count_b", d.alias("delta"), F.when(x > 0, 100.0 * d / x).when(y > 0, 100.0).otherwise(0.0).alias("percent"),
        F.when(d > 0, "regression").when(d < 0, "optimization").otherwise("same").alias("kind"),
    )


def health_issues(metrics: DataFrame) -> DataFrame:
    """metrics(non_heap_mb, loaders, hits, misses, collections, max_pause_ms, ...) plus issues, severity, healthy."""
    c = F.col
    rate = ratio(c("hits"), c("hits") + c("misses"))
    issue = lambda part, level: F.struct(F.lit(part).alias("component"), level.alias("level"))
    grade = lambda x, limit, factor: F.when(x > limit * factor, 2).otherwise(1)
    found = F.array(
        F.when(c("non_heap_mb") > NON_HEAP_MB, issue("Metaspace", F.lit(1))),
        F.when(c("loaders") > LOADERS, issue("ClassLoaderManager", grade(c("loaders"), LOADERS, 2))),
        F.when((c("hits") + c("misses") > MIN_REQUESTS) & (rate < HIT_RATE), issue("TieredCache", F.lit(1))),
        F.when((c("collections") > 0) & (c("max_pause_ms") > PAUSE_MS), issue("GarbageCollector", grade(c("max_pause_ms"), PAUSE_MS, 5))),
    )
    issues = F.filter(found, lambda x: x.isNotNull())
    worst = F.coalesce(F.array_max(F.transform(issues, lambda x: x["level"])), F.lit(0))
    names = F.when(worst == 2, "CRITICAL").when(worst == 1, "WARNING").otherwise("INFO")
    return metrics.withColumns({"issues": issues, "severity": names, "healthy": worst < 2})


def profile_totals(diff: DataFrame) -> DataFrame:
    """total_a, total_b, net of a profile_diff."""
    a, b = F.coalesce(F.sum("count_a"), F.lit(0)), F.coalesce(F.sum("count_b"), F.lit(0))
    return diff.agg(a.alias("total_a"), b.alias("total_b"), (b - a).alias("net"))


def execution_stats(calls: DataFrame, thread: str, order: str, kind: str, nanos: str) -> DataFrame:
    """thread, executions, total_nanos of ENTRY/EXIT events paired like brackets; a nested call counts in its caller's time too.

    An exit without an entry is ignored. Running sums give each event its depth; the events of one depth alternate,
    so an exit's entry is the one before it.
    """
    so_far = Window.partitionBy(thread).orderBy(order)
    upto = so_far.rowsBetween(Window.unboundedPreceding, 0)
    entry = F.col(kind) == "ENTRY"
    sums = calls.select(thread, order, kind, nanos).withColumn("_sum", F.sum(F.when(entry, 1).otherwise(-1)).over(upto))
    lows = sums.withColumn("_low", F.least(F.lit(0), F.min("_sum").over(upto)))
    lone = ~entry & (F.col("_sum") < F.coalesce(F.lag("_low").over(so_far), F.lit(0)))
    depth = F.col("_sum") - F.col("_low")
    placed = lows.withColumn("_lone", lone).withColumn("_depth", F.when(F.col("_lone"), 0).when(entry, depth).otherwise(depth + 1))
    before = F.lag(nanos).over(Window.partitionBy(thread, "_depth").orderBy(order))
    done = placed.withColumn("_took", F.when(~entry & ~F.col("_lone"), F.col(nanos) - before))
    return done.groupBy(thread).agg(F.count("_took").alias("executions"), F.coalesce(F.sum("_took"), F.lit(0)).cast("long").alias("total_nanos"))
