"""The engine's queries over the shared tables, each with the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.operators import logs, runtime, stats
from ferrule.operators.rules import CompiledRule, apply_rules_long, compile_rule, rule_summary
from ferrule.sources.rules import Rule

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rule(name: str, expression: str, equality: str = "strict", optimize: bool = True, **schema: str) -> CompiledRule:
    return compile_rule(Rule(name, expression, input_schema=schema), optimize, equality)


FRAUD = rule("FraudDetectionRule", 'amount > 10000 && country != "US"', amount="double", country="string")


def flat(df: DataFrame, r: CompiledRule, keys: list[str], binding: dict[str, str] | None = None) -> DataFrame:
    x = r.result(df, binding)
    return df.select(*keys, x["success"].alias("success"), x["result"].alias("result"), x["error"].alias("error"))


MISSING = "'Missing variable in execution context: "


@query("""select n_name, count(*) as n, sum(o_totalprice) as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
where o_totalprice > 10000 and n_name <> 'US' group by n_name""")
def fraud_orders(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    hits = FRAUD.where(joined, {"amount": "o_totalprice", "country": "n_name"})
    return hits.groupBy("n_name").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))


@query(f"""with e as (select event_id, case when event_id % 7 <> 0 then user_id end as x, case when event_id % 5 <> 0 then event_type end as t from events)
select event_id, x is not null and (x <= 50 or t is not null) as success,
case when x is null or (x > 50 and t is null) then null when x > 50 then t <> 'view' else false end as result,
case when x is null then {MISSING}x' when x > 50 and t is null then {MISSING}t' end as error from e""")
def rule_struct_missing(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").selectExpr("event_id", "case when event_id % 7 <> 0 then user_id end as x", "case when event_id % 5 <> 0 then event_type end as t")
    return flat(e, rule("missing", "x > 50 && t != 'view'", x="long", t="string"), ["event_id"])


@query(f"""with e as (select event_id, case when event_id % 7 <> 0 then user_id end as x, case when event_id % 5 <> 0 then event_type end as t from events)
select event_id, x is not null and (x > 50 or t is not null) as success,
case when x is null or (x <= 50 and t is null) then null when x > 50 then true else t = 'view' end as result,
case when x is null then {MISSING}x' when x <= 50 and t is null then {MISSING}t' end as error from e""")
def rule_or_shortcircuit(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").selectExpr("event_id", "case when event_id % 7 <> 0 then user_id end as x", "case when event_id % 5 <> 0 then event_type end as t")
    return flat(e, rule("either", "x > 50 || t == 'view'", x="long", t="string"), ["event_id"])


@query("""with e as (select event_id, case when event_id % 7 <> 0 then user_id end as x, case when event_id % 5 <> 0 then event_type end as t from events)
select event_id from e where x is not null and not (x > 50 and t is null) and not (x > 50 and t <> 'view')""")
def rule_filter_dual(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").selectExpr("event_id", "case when event_id % 7 <> 0 then user_id end as x", "case when event_id % 5 <> 0 then event_type end as t")
    return rule("not", "!(x > 50 && t != 'view')", x="long", t="string").where(e).select("event_id")


@query("select p_partkey, false as result from part")
def strict_int_equality(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", rule("strict", "p_size == 15", p_size="int").value(p).alias("result"))


@query("select p_partkey, p_size = 15 as result from part")
def numeric_equality_mode(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", rule("numeric", "p_size == 15", "numeric", p_size="int").value(p).alias("result"))


@query("select l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) as result from lineitem")
def discount_formula(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem")
    r = rule("revenue", "l_extendedprice * (1 - l_discount)", l_extendedprice="double", l_discount="double")
    return x.select("l_orderkey", "l_linenumber", r.value(x).alias("result"))


@query("select l_orderkey, l_linenumber, l_orderkey // 7 as result from lineitem")
def int_division(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem")
    return x.select("l_orderkey", "l_linenumber", rule("div", "l_orderkey / 7", l_orderkey="long").value(x).alias("result"))


@query("""select l_orderkey, l_linenumber, l_linenumber <> 3 as success, case when l_linenumber <> 3 then l_orderkey // (l_linenumber - 3) end as result,
case when l_linenumber = 3 then '/ by zero' end as error from lineitem""")
def zero_division(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem")
    return flat(x, rule("zero", "l_orderkey / (l_linenumber - 3)", l_orderkey="long", l_linenumber="int"), ["l_orderkey", "l_linenumber"])


@query("select l_orderkey, l_linenumber, case when l_extendedprice > 0 then 'Infinity' else 'NaN' end as result from lineitem")
def double_zero_division(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem")
    r = rule("ieee", "l_extendedprice / (l_discount - l_discount)", l_extendedprice="double", l_discount="double")
    return x.select("l_orderkey", "l_linenumber", r.value(x).cast("string").alias("result"))


@query("""select p_partkey, cast(((cast(p_size as hugeint) * 99999999 * p_size + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 as integer) as result
from part""")
def int_overflow_wrap(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("big", F.lit(99999999))
    return p.select("p_partkey", rule("wrap", "p_size * big * p_size", p_size="int", big="int").value(p).alias("result"))


@query("""select o_orderkey, cast(((cast(o_orderkey as hugeint) * 4611686018427387904 * 3 + 9223372036854775808) % 18446744073709551616) - 9223372036854775808 as bigint) as result
from orders""")
def long_overflow_wrap(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select("o_orderkey", rule("wrap", "o_orderkey * 4611686018427387904 * 3", o_orderkey="long").value(o).alias("result"))


@query("select c_custkey, c_name || '/' || n_name || '/' || c_custkey as result from customer join nation on c_nationkey = n_nationkey")
def string_concat_rule(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    r = rule("concat", "c_name + '/' + n_name + '/' + c_custkey", c_name="string", n_name="string", c_custkey="long")
    return j.select("c_custkey", r.value(j).alias("result"))


@query("""select c_custkey, suffix(c_name, '7') as ends, lower(c_mktsegment) = 'building' as same, contains(c_name, '00') as has, length(c_name) > 10 as long_name,
upper(c_mktsegment) as up, strpos(c_name, '0') - 1 as at from customer""")
def string_methods(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    s = {"c_name": "string", "c_mktsegment": "string"}
    of = lambda e: rule("m", e, **s).value(c)
    return c.select(
        "c_custkey", of("c_name.endsWith('7')").alias("ends"), of("c_mktsegment.equalsIgnoreCase('Building')").alias("same"), of("c_name.contains('00')").alias("has"),
        of("c_name.length() > 10").alias("long_name"), of("c_mktsegment.toUpperCase()").alias("up"), of("c_name.indexOf('0')").alias("at"),
    )


@query("select o_orderkey, o_totalprice > 50000 and o_orderstatus = 'O' as folded, o_totalprice > 50000 and o_orderstatus = 'O' as plain from orders")
def constant_fold_equivalence(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    text, s = "(o_totalprice > 20000 + 3 * 10000 && true) && (false || o_orderstatus == 'O')", {"o_totalprice": "double", "o_orderstatus": "string"}
    return o.select("o_orderkey", rule("f", text, **s).value(o).alias("folded"), rule("p", text, optimize=False, **s).value(o).alias("plain"))


def _order_rules() -> list[CompiledRule]:
    s = {"o_totalprice": "double", "o_orderstatus": "string", "o_custkey": "long"}
    return [
        rule("large", "o_totalprice > 100000", **s), rule("open_or_small", "o_orderstatus == 'O' || o_totalprice < 5000", **s),
        rule("ratio", "1000 / (o_custkey - o_custkey / 10 * 10)", **s),
    ]


_LONG = """select o_orderkey, 'large' as rule, true as success, (o_totalprice > 100000)::varchar as result, null::varchar as error from orders
union all select o_orderkey, 'open_or_small', true, (o_orderstatus = 'O' or o_totalprice < 5000)::varchar, null from orders
union all select o_orderkey, 'ratio', o_custkey % 10 <> 0, case when o_custkey % 10 <> 0 then (1000 // (o_custkey % 10))::varchar end,
case when o_custkey % 10 = 0 then '/ by zero' end from orders"""


@query(_LONG)
def multi_rule_long(spark: SparkSession, d: str) -> DataFrame:
    return apply_rules_long(table(spark, d, "orders"), _order_rules(), ["o_orderkey"])


@query(f"""select rule, count(*) as total, count(*) filter (where success) as success, count(*) filter (where not success) as failed,
count(*) filter (where success and result = 'true') as matched from ({_LONG}) group by rule""")
def rule_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rule_summary(multi_rule_long(spark, d))


@query("select event_type, quantile_cont(value, 0.5) as p50, quantile_cont(value, 0.95) as p95, quantile_cont(value, 0.99) as p99 from events group by event_type")
def duration_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return stats.percentiles(table(spark, d, "events"), "value", ("event_type",))


@query("""with w as (select value from events order by event_id desc limit 5000)
select quantile_cont(value, 0.5) as p50, quantile_cont(value, 0.95) as p95, quantile_cont(value, 0.99) as p99 from w""")
def percentiles_last_n(spark: SparkSession, d: str) -> DataFrame:
    return stats.percentiles(stats.last_n(table(spark, d, "events"), 5000, ["event_id"]), "value")


_ACCESS = """with a as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as n from events),
p as (select *, case when n > 20 then 'L1' when n > 5 then 'L2' else 'L3' end as tier, n in (5, 20) as promoted from a)"""


@query(f"{_ACCESS} select user_id, event_id, n, tier, promoted from p")
def cache_promotions(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "events").select("user_id", "event_id")
    return stats.cache_promotions(a, "user_id", ["event_id"])


@query("""with e as (select case when event_type = 'error' then 'MISS' when event_type = 'signup' then 'PROMOTE' else 'HIT' end as op, 'L' || (1 + user_id % 3) as tier from events)
select count(*) filter (where op = 'HIT' and tier = 'L1') as l1_hits, count(*) filter (where op = 'HIT' and tier = 'L2') as l2_hits,
count(*) filter (where op = 'HIT' and tier = 'L3') as l3_hits, count(*) filter (where op = 'MISS') as misses, count(*) filter (where op = 'PROMOTE') as promotions,
0::bigint as demotions, 0::bigint as evictions, count(*) filter (where op = 'HIT') as total_hits, count(*) filter (where op in ('HIT', 'MISS')) as total_requests,
count(*) filter (where op = 'HIT') / count(*) filter (where op in ('HIT', 'MISS')) as hit_rate from e""")
def cache_hit_rate(spark: SparkSession, d: str) -> DataFrame:
    op = "case when event_type = 'error' then 'MISS' when event_type = 'signup' then 'PROMOTE' else 'HIT' end as op"
    return stats.cache_stats(table(spark, d, "events").selectExpr(op, "concat('L', 1 + user_id % 3) as tier"))


# Log lines are made of whole numbers, alike in both engines.
_GC = """concat('[', event_id, '.', 100 + event_id % 900, 's][info][gc] GC(', event_id, ') ', case when event_id % 10 = 0 then 'Pause Full (System.gc())' else
'Pause Young (Normal) (G1 Evacuation Pause)' end, ' ', 20 + event_id % 30, 'M->', 4 + event_id % 40, 'M(256M) ', event_id % 97, '.', 100 + event_id % 900, 'ms')"""
_GC_SQL = f"""with l as (select event_id, {_GC} as line from events), g as (select event_id,
trunc(concat(event_id, '.', 100 + event_id % 900)::double * 1000.0::double)::bigint as timestamp_ms, event_id::integer as gc_id, case when event_id % 10 = 0 then 'Pause Full' else 'Pause Young (Normal)' end as type,
case when event_id % 10 = 0 then 'System.gc()' else 'G1 Evacuation Pause' end as cause, (regexp_extract(line, ' ([0-9]+)M->', 1)::bigint * 1024) as heap_before_kb,
(regexp_extract(line, '->([0-9]+)M', 1)::bigint * 1024) as heap_after_kb, 262144::bigint as heap_total_kb, regexp_extract(line, ' ([0-9.]+)ms$', 1)::double as pause_ms,
event_id % 10 = 0 as is_full, greatest(0, heap_before_kb - heap_after_kb)::bigint as reclaimed_kb from l)"""


def _gc(spark: SparkSession, d: str) -> DataFrame:
    return logs.parse_gc(table(spark, d, "events").selectExpr("event_id", f"{_GC} as line"))


@query(f"{_GC_SQL} select * from g")
def gc_parse(spark: SparkSession, d: str) -> DataFrame:
    return _gc(spark, d)


@query(f"""{_GC_SQL} select event_id % 8 as part, count(*) as total_collections, count(*) filter (where is_full) as full_gc, count(*) filter (where not is_full) as young_gc,
round(sum(pause_ms), 3) as total_pause_ms, max(pause_ms) as max_pause_ms, round(avg(pause_ms), 6) as avg_pause_ms, sum(reclaimed_kb)::bigint as reclaimed_kb,
round(greatest(0, 1e9 - sum(pause_ms)) / 1e9 * 100, 6) as throughput from g group by 1""")
def gc_stats(spark: SparkSession, d: str) -> DataFrame:
    s = stats.gc_stats(_gc(spark, d).withColumn("part", F.col("event_id") % 8), ("part",))
    share = F.round(stats.throughput(F.col("total_pause_ms"), F.lit(1e9)), 6)
    return s.withColumns({"throughput": share, "total_pause_ms": F.round("total_pause_ms", 3), "avg_pause_ms": F.round("avg_pause_ms", 6)})


_SAFE = """concat('[', event_id, '.', 100 + event_id % 900, 's][info][safepoint] Safepoint "', event_type, '", Time since last: ', 1000 + event_id, ' ns, Reaching safepoint: ',
event_id * 3, ' ns, At safepoint: ', event_id * 5, ' ns, Total: ', event_id * 8, ' ns')"""


@query("""select event_id, trunc(concat(event_id, '.', 100 + event_id % 900)::double * 1000.0::double)::bigint as timestamp_ms, event_type as name, 1000 + event_id as since_last_ns, event_id * 3 as reaching_ns,
event_id * 5 as at_ns, event_id * 8 as total_ns, event_id * 8 / 1e6 as total_ms, event_id * 3 / 1e6 as reaching_ms from events""")
def safepoint_parse(spark: SparkSession, d: str) -> DataFrame:
    return logs.parse_safepoint(table(spark, d, "events").selectExpr("event_id", f"{_SAFE} as line"))


_JIT = """concat('  ', event_id, '  ', 1 + event_id % 100000, '  ', case when event_id % 6 = 0 then '%' else ' ' end, case when event_id % 4 = 0 then '!' else ' ' end,
case when event_id % 9 = 0 then 's' else ' ' end, '  ', 1 + event_id % 4, '   app.C', user_id % 50, '::run (', 10 + event_id % 300, ' bytes)',
case when event_id % 11 = 0 then '   made not entrant' else '' end)"""
_JIT_SQL = """with j as (select event_id, event_id as timestamp_ms, (1 + event_id % 100000)::integer as compile_id, (1 + event_id % 4)::integer as tier,
'app.C' || (user_id % 50) || '::run' as method, (10 + event_id % 300)::integer as bytecode_size, event_id % 6 = 0 as is_osr, event_id % 9 = 0 as is_synchronized,
event_id % 4 = 0 as is_exception_handler, case when event_id % 11 = 0 then 'made not entrant' else 'NORMAL' end as status, event_id % 11 = 0 as is_deopt from events)"""


def _jit(spark: SparkSession, d: str) -> DataFrame:
    return logs.parse_jit(table(spark, d, "events").selectExpr("event_id", f"{_JIT} as line"))


@query(f"{_JIT_SQL} select * from j")
def jit_parse(spark: SparkSession, d: str) -> DataFrame:
    return _jit(spark, d)


@query(f"""{_JIT_SQL} select count(*) as total, count(*) filter (where tier = 1) as tier1, count(*) filter (where tier = 2) as tier2, count(*) filter (where tier = 3) as tier3,
count(*) filter (where tier = 4) as tier4, count(*) filter (where tier < 4) as c1, sum(bytecode_size)::bigint as total_bytecode, avg(bytecode_size) as avg_bytecode,
count(*) filter (where is_deopt) as deopts, count(*) filter (where is_osr) as osr from j""")
def jit_tier_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.jit_stats(_jit(spark, d))


@query(f"""{_JIT_SQL}, r as (select method, max(event_id) as reset from j where is_deopt group by method)
select j.method, coalesce(max(tier) filter (where reset is null or event_id > reset), 0) as current_tier, count(*) as compilations,
coalesce(max(tier) filter (where reset is null or event_id > reset), 0) = 4 as is_c2 from j left join r on j.method = r.method group by j.method""")
def jit_current_tier(spark: SparkSession, d: str) -> DataFrame:
    return stats.current_tier(_jit(spark, d), "event_id")


_INLINE = """concat('   @ ', event_id % 500, '   app.C', user_id % 50, '::get (', event_id % 400, ' bytes)   ', case when event_id % 3 = 0 then 'inline (hot)'
when event_id % 3 = 1 then 'too big' else 'not inlined' end)"""


@query("""select event_id, (event_id % 500)::integer as bytecode_index, 'app.C' || (user_id % 50) || '::get' as target_method, (event_id % 400)::integer as bytecode_size,
event_id % 3 <> 1 as inlined, case when event_id % 3 = 0 then 'inline (hot)' when event_id % 3 = 1 then 'too big' else 'not inlined' end as reason from events""")
def inlining_parse(spark: SparkSession, d: str) -> DataFrame:
    return logs.parse_inlining(table(spark, d, "events").selectExpr("event_id", f"{_INLINE} as line"))


_STACK = "concat('main;', event_type, ';f', user_id % 7, ' ', 1 + event_id % 10)"


def _stacks(spark: SparkSession, d: str) -> DataFrame:
    return logs.parse_stacks(table(spark, d, "events").selectExpr("event_id as line_no", f"{_STACK} as line"))


@query("""with s as (select 'main;' || event_type || ';f' || (user_id % 7) as stack, sum(1 + event_id % 10)::bigint as count from events group by 1)
select stack, count, 100.0::double * count / sum(count) over () as percent, greatest(5.0::double, 100.0::double * count / sum(count) over ()) as width from s""")
def flame_share(spark: SparkSession, d: str) -> DataFrame:
    return stats.flame_shares(_stacks(spark, d).groupBy("stack").agg(F.sum("count").alias("count")))


@query("""with s as (select event_id, 'main;' || event_type || ';f' || (user_id % 7) as stack, (1 + event_id % 10)::bigint as count from events),
a as (select stack, arg_max(count, event_id) as count_a from s where event_id % 2 = 0 and not suffix(stack, 'f3') group by stack),
b as (select stack, arg_max(count, event_id) as count_b from s where event_id % 2 = 1 and not suffix(stack, 'f5') group by stack),
j as (select coalesce(a.stack, b.stack) as stack, coalesce(count_a, 0) as count_a, coalesce(count_b, 0) as count_b from a full join b on a.stack = b.stack)
select *, count_b - count_a as delta, case when count_a > 0 then 100.0::double * (count_b - count_a) / count_a when count_b > 0 then 100.0::double else 0.0::double end as percent,
case when count_b > count_a then 'regression' when count_b < count_a then 'optimization' else 'same' end as kind from j""")
def profile_diff(spark: SparkSession, d: str) -> DataFrame:
    s = _stacks(spark, d)
    odd = F.col("line_no") % 2 == 1
    return stats.profile_diff(s.where(~odd & ~F.endswith("stack", F.lit("f3"))), s.where(odd & ~F.endswith("stack", F.lit("f5"))))


@query("""with m as (select user_id % 100 as part, max(event_id % 400)::bigint as non_heap_mb, count(distinct user_id)::bigint * 9 as loaders,
count(*) filter (where event_type = 'view') as hits, count(*) filter (where event_type <> 'view') as misses, count(*) as collections, max(value) as max_pause_ms
from events group by 1), g as (select *, case when hits + misses > 0 then hits / (hits + misses) else 0 end as rate from m),
i as (select *, case when loaders > 100 or max_pause_ms > 500 then 2 when non_heap_mb > 250 or loaders > 50 or (hits + misses > 20 and rate < 0.4) or max_pause_ms > 100 then 1 else 0 end as level,
(non_heap_mb > 250)::int + (loaders > 50)::int + (hits + misses > 20 and rate < 0.4)::int + (max_pause_ms > 100)::int as n from g)
select part, n::integer as n_issues, case level when 2 then 'CRITICAL' when 1 then 'WARNING' else 'INFO' end as severity, level < 2 as healthy from i""")
def health_issues(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "events").groupBy((F.col("user_id") % 100).alias("part")).agg(
        F.max(F.col("event_id") % 400).alias("non_heap_mb"), (F.count_distinct("user_id") * 9).alias("loaders"), F.count_if(F.col("event_type") == "view").alias("hits"),
        F.count_if(F.col("event_type") != "view").alias("misses"), F.count("*").alias("collections"), F.max("value").alias("max_pause_ms"),
    )
    return stats.health_issues(m).select("part", F.size("issues").alias("n_issues"), "severity", "healthy")


@query("""select user_id as thread, count(*) // 2 as executions, sum(case when n % 2 = 0 then event_id - before else 0 end)::bigint as total_nanos from (
select user_id, event_id, row_number() over w as n, lag(event_id) over w as before from events window w as (partition by user_id order by event_id)) group by user_id""")
def thread_execution_stats(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    calls = table(spark, d, "events").select(F.col("user_id").alias("thread"), F.col("event_id").alias("at"), F.when(n % 2 == 1, "ENTRY").otherwise("EXIT").alias("kind"))
    return stats.execution_stats(calls.withColumn("nanos", F.col("at")), "thread", "at", "kind", "nanos")


@query(f"""with s as (select count(*) as total, count(*) filter (where success) as succeeded, count(*) filter (where not success) as failed from ({_LONG}))
select 'total' as key, total::varchar as value from s union all select 'succeeded', succeeded::varchar from s union all select 'failed', failed::varchar from s""")
def report_rows(spark: SparkSession, d: str) -> DataFrame:
    from ferrule.report import pairs

    return pairs(stats.executor_metrics(multi_rule_long(spark, d)))


@query("select event_type, count(*) as n from events where value > 10 and event_type <> 'view' group by event_type")
def event_router_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream through a rule to a running count, drained to the end; state and counts lie in the shared folder."""
    import tempfile
    import uuid

    events = table(spark, d, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{d}/events.parquet*" if not d.startswith("viewfs") else f"{d}/events.parquet")
    hits = rule("route", "value > 10 && event_type != 'view'", value="double", event_type="string").where(stream)
    shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="ferrule-")  # set on any cluster
    out = f"{shared}/routed-{uuid.uuid4().hex}"
    counts = hits.groupBy("event_type").agg(F.count("*").alias("n"))
    write = lambda df, _: df.write.mode("overwrite").parquet(f"{out}/counts")
    q = counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/counts")


# Lines of collections, safepoints and noise, with uptimes of a tenth of a millisecond.
_MIXED = """concat('[', event_id, '.', 1000 + event_id % 9000, case event_id % 3 when 0 then concat('s][info][gc] GC(', event_id, ') Pause Young (Normal) ', 9 + event_id % 5, 'M->4M(64M) 1.5ms')
when 1 then concat('s][info][safepoint] Safepoint "Cleanup", Time since last: 5 ns, Reaching safepoint: 1 ns, At safepoint: ', event_id, ' ns, Total: ', event_id + 1, ' ns') else 's] other' end)"""


@query("""select event_id, case event_id % 3 when 0 then 'gc' else 'safepoint' end as kind, trunc(concat(event_id, '.', 1000 + event_id % 9000)::double * 1000.0::double)::bigint as timestamp_ms,
case event_id % 3 when 0 then (9 + event_id % 5) * 1024 - 4096 else event_id + 1 end::bigint as amount from events where event_id % 3 < 2""")
def gc_scan_fallback(spark: SparkSession, d: str) -> DataFrame:
    gc, safe = logs.scan_gc(table(spark, d, "events").selectExpr("event_id", f"{_MIXED} as line"))
    return gc.select("event_id", F.lit("gc").alias("kind"), "timestamp_ms", F.col("reclaimed_kb").alias("amount")).unionByName(
        safe.select("event_id", F.lit("safepoint").alias("kind"), "timestamp_ms", F.col("total_ns").alias("amount"))
    )


@query(f"""{_JIT_SQL}, h as (select * from j order by event_id desc limit 500)
select 'method' as predicate, event_id, method, tier from h where contains(method, 'C1') union all select 'tier', event_id, method, tier from h where tier = 4
union all select 'deopt', event_id, method, tier from h where is_deopt""")
def jit_history(spark: SparkSession, d: str) -> DataFrame:
    h = runtime.history(_jit(spark, d), "event_id", 500)
    named = lambda df, n: df.select(F.lit(n).alias("predicate"), "event_id", "method", "tier")
    return named(runtime.for_method(h, "C1"), "method").unionByName(named(runtime.for_tier(h, 4), "tier")).unionByName(named(runtime.deoptimizations(h), "deopt"))


@query(f"""{_JIT_SQL} select method, event_id, tier, is_deopt, row_number() over (partition by method order by event_id) as nth, count(*) over (partition by method) as transitions from j""")
def jit_method_history(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    own = Window.partitionBy("method")
    return _jit(spark, d).select("method", "event_id", "tier", "is_deopt", F.row_number().over(own.orderBy("event_id")).alias("nth"), F.count("*").over(own).alias("transitions"))


@query(f"""{_JIT_SQL} select 'C4' as part, coalesce(max(tier) filter (where contains(method, 'C4')), 0) as highest_tier from j union all select 'none', 0""")
def jit_highest_tier(spark: SparkSession, d: str) -> DataFrame:
    events = _jit(spark, d)
    one = lambda part: runtime.highest_tier(events, part).select(F.lit(part).alias("part"), "highest_tier")
    return one("C4").unionByName(one("none"))


@query("""with e as (select event_id, (event_id % 400)::integer as size, event_id % 2 = 0 as hot from events), l as (select *, case when hot then 325 else 35 end as lim from e)
select event_id, size <= lim as inlined, 'Bytecode size (' || size || ' bytes) ' || case when size <= lim then '<=' else '>' end || ' limit (' || lim || ' bytes)' ||
case when size <= lim then '' else ', inlining rejected' end as reason from l""")
def inline_limits(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").selectExpr("event_id", "cast(event_id % 400 as int) as size", "event_id % 2 = 0 as hot")
    inlined, reason = runtime.inline_decision(F.col("size"), F.col("hot"))
    return e.select("event_id", inlined.alias("inlined"), reason.alias("reason"))


@query("""with c as (select user_id, count(*) * 150 as calls from events group by user_id)
select user_id, calls, case when calls >= 15000 then 4 when calls >= 100 then 3 else 0 end as highest_tier, (calls >= 100)::integer + (calls >= 2000)::integer as c1,
(calls >= 15000)::integer as c2, calls >= 2000 as inlined from c""")
def tier_schedule(spark: SparkSession, d: str) -> DataFrame:
    return runtime.scheduled_compilations(table(spark, d, "events").groupBy("user_id").agg((F.count("*") * 150).alias("calls")), "calls")


@query("""with p as (select event_id, 'main;' || event_type || ';f' || (user_id % 7) as stack, (1 + event_id % 10)::bigint as count from events),
a as (select stack, arg_max(count, event_id) as n from p where event_id % 2 = 0 group by stack), b as (select stack, arg_max(count, event_id) as n from p where event_id % 2 = 1 group by stack)
select (select sum(n) from a)::bigint as total_a, (select sum(n) from b)::bigint as total_b, ((select sum(n) from b) - (select sum(n) from a))::bigint as net""")
def profile_totals(spark: SparkSession, d: str) -> DataFrame:
    s = _stacks(spark, d)
    return stats.profile_totals(stats.profile_diff(s.where("line_no % 2 = 0"), s.where("line_no % 2 = 1")))


@query("""select count(*) filter (where event_type = 'signup') - count(*) filter (where event_type = 'error') as active, count(*) filter (where event_type = 'view') as classes_loaded,
count(*) filter (where event_type = 'error') as closed from events""")
def loader_counters(spark: SparkSession, d: str) -> DataFrame:
    return runtime.loader_counters(table(spark, d, "events").selectExpr("case event_type when 'signup' then 'CREATED' when 'error' then 'CLOSED' when 'view' then 'LOADED' end as kind"))


@query("select event_id as id from events where event_id % 3 = 0 and event_type = 'error'")
def loader_leaks(spark: SparkSession, d: str) -> DataFrame:
    loaders = table(spark, d, "events").selectExpr("event_id as id", "event_id % 3 = 0 as referenced", "event_type = 'error' as closed")
    return runtime.leaked_loaders(loaders).select("id")


@query("""select count(*) filter (where event_type = 'signup') as rules_compiled, count(*) filter (where event_type = 'view') as rules_executed,
count(*) filter (where event_type = 'click') as cache_hits, count(*) filter (where event_type = 'error') as cache_misses,
coalesce(greatest(0, arg_max(event_id % 90 - 40, event_id) filter (where event_type = 'purchase')), 1)::bigint as active_loaders, 0::bigint as metaspace_bytes from events""")
def engine_gauges(spark: SparkSession, d: str) -> DataFrame:
    kind = "case event_type when 'signup' then 'COMPILED' when 'view' then 'EXECUTED' when 'click' then 'HIT' when 'error' then 'MISS' when 'purchase' then 'LOADERS' end as kind"
    found = runtime.engine_counters(table(spark, d, "events").selectExpr(kind, "event_id % 90 - 40 as value", "event_id"), "event_id")
    return found.withColumns({c: F.col(c).cast("long") for c in ("active_loaders", "metaspace_bytes")})


@query("""with a as (select case when event_id % 5 = 0 then ' ' when event_id % 7 = 0 then null else 'app.' || event_type end as class_name from events)
select class_name, count(*) as n from a where trim(class_name) <> '' group by class_name union all select null, count(*) from a""")
def allocations_by_class(spark: SparkSession, d: str) -> DataFrame:
    return runtime.allocations(table(spark, d, "events").selectExpr("case when event_id % 5 = 0 then ' ' when event_id % 7 = 0 then null else concat('app.', event_type) end as class_name"))


_NAME = """case event_id % 5 when 0 then null when 1 then concat('org.slf4j.L-', event_type) when 2 then concat('ferrule.api.', user_id, '$x') else concat('my rule/', event_type) end as name"""
_MODE = "case event_id % 4 when 0 then 'ALLOC' when 1 then 'Wall' when 2 then 'none' end as mode"


@query(f"""with n as (select event_id, {_NAME}, {_MODE} from events) select event_id, coalesce(regexp_replace(name, '[^a-zA-Z0-9_]', '_', 'g'), 'anon') as safe, coalesce(starts_with(name, 'org.slf4j') or starts_with(name, 'ferrule.api'), false) as shared,
case mode when 'ALLOC' then 'alloc' when 'Wall' then 'wall' else 'cpu' end as mode from n""")
def names_and_modes(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "events").selectExpr("event_id", _NAME, _MODE)
    return n.select("event_id", runtime.sanitised(F.col("name")).alias("safe"), runtime.shared_package(F.col("name")).alias("shared"), runtime.profile_mode(F.col("mode")).alias("mode"))


@query("""select event_id, case when event_id % 2 = 0 then 'false' else 'true' end as retransform, case when event_id % 3 = 0 then 'DEBUG' else event_type end as log_level from events""")
def agent_settings(spark: SparkSession, d: str) -> DataFrame:
    args = "concat('retransform=', event_id % 2 <> 0, ', logLevel=', event_type, case when event_id % 3 = 0 then ';logLevel=DEBUG' else ';' end)"
    e = table(spark, d, "events").select("event_id", runtime.settings(F.expr(args)).alias("s"))
    return e.select("event_id", F.col("s")["retransform"].alias("retransform"), F.col("s")["logLevel"].alias("log_level"))


@query("""select case when event_type = 'error' then 'execution' else 'cache_eviction' end as kind, count(*) as n from events group by 1""")
def recorded_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("rule_name", F.col("event_type"))
    both = runtime.record(e.where("event_type = 'error'"), "execution").unionByName(runtime.record(e.where("event_type <> 'error'"), "cache_eviction"))
    return both.groupBy("kind").agg(F.count("*").alias("n"))


@query("""with e as (select event_id, event_type as t, case event_id % 4 when 0 then '[' when 1 then 'v.*' when 2 then '.*(i|r).*' else event_type end as p from events)
select event_id, p <> '[' as success, case when p <> '[' then regexp_full_match(t, p) end as result, case when p = '[' then 'Method invocation failed: matches' end as error from e""")
def regex_calls(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").selectExpr("event_id", "event_type as t", "case event_id % 4 when 0 then '[' when 1 then 'v.*' when 2 then '.*(i|r).*' else event_type end as p")
    return flat(e, rule("regex", "t.matches(p)", t="string", p="string"), ["event_id"])


@query("""with e as (select event_id, event_type as t from events), k as (select *, list_filter(range(1, least(length(t), 6) + 1), lambda i: t[i] <> 'signup'[i])[1] as k,
list_reduce(list_transform(string_split(t, ''), lambda c: ascii(c)::bigint), lambda h, c: (h * 31 + c) & 4294967295) as h from e)
select event_id, '-' || array_to_string(string_split(t, ''), '-') || '-' as spread, regexp_replace(t, '[aeiou]', '#') as first, (case when h >= 2147483648 then h - 4294967296 else h end)::integer as hash,
(case when t = 'signup' then 0 when k is not null then ascii(t[k]) - ascii('signup'[k]) else length(t) - 6 end)::integer as compared, regexp_replace(t, '(.)i', '<\\1>', 'g') as every from k""")
def more_string_methods(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").selectExpr("event_id", "event_type as t")
    calls = {"spread": 't.replace("", "-")', "first": 't.replaceFirst("[aeiou]", "#")', "hash": "t.hashCode()", "compared": 't.compareTo("signup")', "every": 't.replaceAll("(.)i", "<$1>")'}
    return e.select("event_id", *[rule(n, x, t="string").result(e)["result"].alias(n) for n, x in calls.items()])
