"""What a runtime's own records say: compilation history, loaders, gauges, allocations, settings."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.operators.stats import last_n

# Limits of inlining, invocations at which a method is compiled and the tier, profile modes.
COLD_INLINE, HOT_INLINE = 35, 325
SCHEDULE = ((100, 3), (2000, 3), (15000, 4))
INLINED_AT = 2000
MODES = ("cpu", "alloc", "lock", "wall", "itimer")
#: Packages that all isolated loaders take from their shared parent; a parameter of shared_package.
SHARED = ("ferrule.api", "ferrule.plans", "org.slf4j")

# The five kinds of events and their fields.
EVENT_KINDS = {
    "execution": "rule_name string, rule_version string, success boolean, duration_nanos long, error_message string",
    "compilation": "rule_name string, generator_type string, compilation_nanos long, bytecode_bytes int, success boolean",
    "loader_created": "loader_id string, isolation_mode string, parent_name string",
    "cache_eviction": "rule_name string, cache_tier string, reason string",
    "memory_analysis": "class_name string, shallow_bytes long, deep_bytes long, compressed_oops boolean",
}


def history(events: DataFrame, order: str, capacity: int = 10_000) -> DataFrame:
    """The newest `capacity` compilations."""
    return last_n(events, capacity, [order])


def for_method(events: DataFrame, part: str) -> DataFrame:
    return events.where(F.contains("method", F.lit(part)))


def for_tier(events: DataFrame, tier: int) -> DataFrame:
    return events.where(F.col("tier") == tier)


def deoptimizations(events: DataFrame) -> DataFrame:
    return events.where("is_deopt")


def highest_tier(events: DataFrame, part: str) -> DataFrame:
    """highest_tier of the methods whose name holds `part`; 0 without any."""
    return for_method(events, part).agg(F.coalesce(F.max("tier"), F.lit(0)).alias("highest_tier"))


def inline_decision(size: Column, hot: Column) -> tuple[Column, Column]:
    """(inlined, reason) by the limit for cold or hot methods."""
    limit = F.when(hot, HOT_INLINE).otherwise(COLD_INLINE)
    inlined = size <= limit
    reason = F.concat(F.lit("Bytecode size ("), size.cast("string"), F.when(inlined, " bytes) <= limit (").otherwise(" bytes) > limit ("), limit.cast("string"))
    return inlined, F.concat(reason, F.when(inlined, " bytes)").otherwise(" bytes), inlining rejected"))


def scheduled_compilations(calls: DataFrame, invocations: str) -> DataFrame:
    """calls plus highest_tier, c1, c2 (compilations) and inlined, as the schedule has them for so many invocations."""
    n = F.col(invocations)
    reached = [F.when(n >= at, tier) for at, tier in SCHEDULE]
    count = lambda top: sum((F.when((n >= at) & F.lit((tier == 4) == top), 1).otherwise(0) for at, tier in SCHEDULE), F.lit(0))
    return calls.withColumns({"highest_tier": F.coalesce(F.greatest(F.lit(0), *reached), F.lit(0)), "c1": count(False), "c2": count(True), "inlined": n >= INLINED_AT})


def loader_counters(events: DataFrame) -> DataFrame:
    """events(kind CREATED / CLOSED / LOADED) -> active, classes_loaded, closed."""
    of = lambda kind: F.count_if(F.col("kind") == kind)
    return events.agg((of("CREATED") - of("CLOSED")).alias("active"), of("LOADED").alias("classes_loaded"), of("CLOSED").alias("closed"))


def leaked_loaders(loaders: DataFrame) -> DataFrame:
    """Loaders that are closed but still referenced."""
    return loaders.where("referenced and closed")


def engine_counters(events: DataFrame, order: str) -> DataFrame:
    """events(kind, value) -> counters by kind and the last value of each gauge, never below 0.

    Without an event a counter is 0, the loaders 1 and the metaspace 0.
    """
    of = lambda kind: F.count_if(F.col("kind") == kind)
    gauge = lambda kind, none: F.coalesce(F.greatest(F.lit(0), F.max_by(F.when(F.col("kind") == kind, F.col("value")), F.when(F.col("kind") == kind, F.col(order)))), F.lit(none))
    return events.agg(
        of("COMPILED").alias("rules_compiled"), of("EXECUTED").alias("rules_executed"), of("HIT").alias("cache_hits"), of("MISS").alias("cache_misses"),
        gauge("LOADERS", 1).alias("active_loaders"), gauge("METASPACE", 0).alias("metaspace_bytes"),
    )


def allocations(events: DataFrame) -> DataFrame:
    """class_name, n: of each class; blank and missing names count in the total only (class_name NULL holds the total)."""
    named = F.when(F.trim("class_name") != "", F.col("class_name"))
    by_class = events.select(named.alias("class_name")).where("class_name is not null").groupBy("class_name").agg(F.count("*").alias("n"))
    return by_class.unionByName(events.agg(F.count("*").alias("n")).select(F.lit(None).cast("string").alias("class_name"), "n"))


def shared_package(name: Column, packages: tuple[str, ...] = SHARED) -> Column:
    """Whether a class belongs to a package of the shared parent; a missing name does not."""
    return F.coalesce(F.exists(F.array(*map(F.lit, packages)), lambda p: F.startswith(name, p)), F.lit(False))


def sanitised(name: Column) -> Column:
    """A name of letters, digits and underscores; `anon` for none."""
    return F.coalesce(F.regexp_replace(name, "[^a-zA-Z0-9_]", "_"), F.lit("anon"))


def profile_mode(text: Column) -> Column:
    """The mode by its name in any case; cpu for none or an unknown one."""
    low = F.lower(text)
    return F.when(low.isin(*MODES), low).otherwise("cpu")


def settings(args: Column) -> Column:
    """'k=v,k=v;k=v' as a map; of a key that comes twice the last one counts."""
    pairs = F.filter(F.transform(F.split(F.coalesce(args, F.lit("")), "[,;]"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    pair = lambda x: F.struct(F.trim(F.regexp_extract(x, "^([^=:]*)", 1)).alias("k"), F.ltrim(F.regexp_extract(x, "^[^=:]*[=:]?(.*)$", 1)).alias("v"))
    entries = F.transform(pairs, pair)
    last = F.filter(entries, lambda x, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(last)


def agent_settings(args: str | None) -> dict[str, object]:
    """retransform, packages, log_level from 'k=v' pairs, and from the file that configFile names, which wins."""

    def load(text: str) -> dict[str, str]:
        lines = (x.strip() for x in text.splitlines())
        cut = (x.replace(":", "=", 1) if "=" not in x else x for x in lines if x and x[0] not in "#!")
        return {k.strip(): v.strip() for k, _, v in (x.partition("=") for x in cut)}

    given = load((args or "").replace(",", "\n").replace(";", "\n"))
    path = given.get("configFile")
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            given |= load(f.read())
    return {"retransform": given.get("retransform", "true").lower() == "true", "packages": given.get("packages", ""), "log_level": given.get("logLevel", "INFO")}


def record(events: DataFrame, kind: str) -> DataFrame:
    """Rows as events of one of EVENT_KINDS: kind, fields (a JSON object); missing columns are NULL, an error message then empty."""
    schema = [x.split() for x in EVENT_KINDS[kind].split(", ")]
    column = lambda n, t: F.col(n).cast(t) if n in events.columns else F.lit(None).cast(t)
    fields = [(F.coalesce(column(n, t), F.lit("")) if n == "error_message" else column(n, t)).alias(n) for n, t in schema]
    return events.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*fields)).alias("fields"))
