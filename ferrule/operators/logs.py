"""Lines of runtime logs to typed records: DataFrame in, DataFrame out.

Each parser takes a DataFrame with the string column `line` (other columns are carried along, so an
order column survives) and drops lines that don't match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The formats of the log lines.
GC_LINE = r"^\[.*?(?:(\d+(?:\.\d+)?)s)?.*?\]\[info\s*\]\[gc\s*\]\s+GC\((\d+)\)\s+(.+?)\s+([0-9.]+[A-Za-z]+)->([0-9.]+[A-Za-z]+)\(([0-9.]+[A-Za-z]+)\)\s+([0-9.]+)ms$"
GC_CAUSE = r"^(.*?)\s*\(([^\(\)]+(?:\(\))?)\)$"
SAFEPOINT_LINE = r'^\[(?:[^\]]*?(\d+(?:\.\d+)?)s)?.*?\]\[info\s*\]\[safepoint\s*\]\s+Safepoint\s+"([^"]+)",\s+Time since last:\s+(\d+)\s+ns,\s+Reaching safepoint:\s+(\d+)\s+ns,\s+At safepoint:\s+(\d+)\s+ns,\s+Total:\s+(\d+)\s+ns$'
JIT_LINE = r"^\s*(\d+)\s+(\d+)\s+([%s!nb\s]*)\s*([1-4])\s+([^\s]+(?:\s+@[\s\d]+)?)\s+\((\d+)\s+bytes\)(?:\s+(.*))?$"
INLINING_LINE = r"^\s*@\s*(\d+)\s+([^\s]+)\s+\((\d+)\s+bytes\)\s+(.+)$"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 0, in the file's order), line. Large files are read in splits, by many tasks.

    A split's lines come in order; the numbers of lines in the splits before it, a row a split, are added.
    """
    from pyspark.sql import Window

    block = ["file", "_block"]
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line")
    )
    counts = raw.groupBy(*block).agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*block, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_base"))
    return raw.join(base, block).select("file", (F.col("_id") + F.col("_base")).alias("line_no"), "line")


MARK = "\x01"


def _matched(lines: DataFrame, pattern: str, groups: int, text: Column) -> DataFrame:
    """The lines that match, with their groups in one array, so that each line is matched once; a group without a part is empty."""
    marked = F.regexp_replace(text, pattern, MARK + MARK.join(f"${i}" for i in range(1, groups + 1)))
    parts = lines.withColumn("_parts", F.split(marked, MARK, -1))
    return parts.where((F.size("_parts") == groups + 1) & (F.element_at("_parts", 1) == ""))


def _part(i: int) -> Column:
    return F.element_at("_parts", i + 1)


def _uptime_ms(seconds: Column) -> Column:
    """Whole milliseconds of seconds as text, the rest cut off; 0 for none."""
    return (F.when(seconds == "", 0.0).otherwise(seconds.try_cast("double")) * 1000.0).cast("long")


def memory_kb(text: Column) -> Column:
    """'15M' -> 15360: units B, K, M, G in any case, bare digits are bytes, unknown units kilobytes; NULL if unreadable."""
    unit = F.upper(F.substring(text, -1, 1))
    bare = text.rlike(r"^[0-9.]+$")
    number = F.when(bare, text).otherwise(text.substr(F.lit(1), F.length(text) - 1)).try_cast("double")
    factor = F.when(bare | (unit == "B"), 1 / 1024).when(unit == "M", 1024.0).when(unit == "G", 1048576.0).otherwise(1.0)
    return (number * factor).cast("long")


def _rest(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != "line"]


def parse_gc(lines: DataFrame) -> DataFrame:
    """timestamp_ms, gc_id, type, cause, heap_before_kb, heap_after_kb, heap_total_kb, pause_ms, is_full, reclaimed_kb."""
    hit, g = _matched(lines.where(F.contains("line", F.lit("[gc"))), GC_LINE, 7, F.trim("line")), _part
    whole = F.trim(g(3))
    known = whole.rlike(GC_CAUSE)
    out = hit.select(
        *_rest(lines), _uptime_ms(g(1)).alias("timestamp_ms"), g(2).try_cast("int").alias("gc_id"),
        F.when(known, F.trim(F.regexp_extract(whole, GC_CAUSE, 1))).otherwise(whole).alias("type"),
        F.when(known, F.trim(F.regexp_extract(whole, GC_CAUSE, 2))).otherwise("Normal").alias("cause"),
        *[memory_kb(g(i)).alias(n) for i, n in ((4, "heap_before_kb"), (5, "heap_after_kb"), (6, "heap_total_kb"))],
        g(7).try_cast("double").alias("pause_ms"),
    ).where("gc_id is not null and heap_before_kb is not null and heap_after_kb is not null and heap_total_kb is not null and pause_ms is not null")
    full = F.contains(F.lower("type"), F.lit("full")) | F.contains(F.lower("cause"), F.lit("full"))
    return out.withColumns({"is_full": full, "reclaimed_kb": F.greatest(F.lit(0).cast("long"), F.col("heap_before_kb") - F.col("heap_after_kb"))})


def parse_safepoint(lines: DataFrame) -> DataFrame:
    hit, g = _matched(lines.where(F.contains("line", F.lit("[safepoint"))), SAFEPOINT_LINE, 6, F.trim("line")), _part
    names = ("since_last_ns", "reaching_ns", "at_ns", "total_ns")
    out = hit.select(*_rest(lines), _uptime_ms(g(1)).alias("timestamp_ms"), g(2).alias("name"), *[g(i + 3).try_cast("long").alias(n) for i, n in enumerate(names)])
    return out.withColumns({"total_ms": F.col("total_ns") / 1e6, "reaching_ms": F.col("reaching_ns") / 1e6})


def scan_gc(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(collections, safepoints): each line is tried as a collection first and as a safepoint if it is none."""
    return parse_gc(lines), parse_safepoint(lines.where(~F.coalesce(F.contains("line", F.lit("[gc")) & F.rlike(F.trim("line"), F.lit(GC_LINE)), F.lit(False))))


def parse_jit(lines: DataFrame) -> DataFrame:
    hit, g = _matched(lines, JIT_LINE, 7, F.col("line")), _part
    status = F.when(F.trim(g(7)) == "", "NORMAL").otherwise(F.trim(g(7)))
    out = hit.select(
        *_rest(lines), g(1).try_cast("long").alias("timestamp_ms"), g(2).try_cast("int").alias("compile_id"), g(4).cast("int").alias("tier"),
        F.trim(g(5)).alias("method"), g(6).try_cast("int").alias("bytecode_size"), F.contains(g(3), F.lit("%")).alias("is_osr"),
        F.contains(g(3), F.lit("s")).alias("is_synchronized"), F.contains(g(3), F.lit("!")).alias("is_exception_handler"), status.alias("status"),
    )
    return out.withColumn("is_deopt", F.contains("status", F.lit("not entrant")) | F.contains("status", F.lit("zombie")))


def parse_inlining(lines: DataFrame) -> DataFrame:
    hit, g = _matched(lines, INLINING_LINE, 4, F.col("line")), _part
    reason = F.trim(g(4))
    return hit.select(
        *_rest(lines), g(1).try_cast("int").alias("bytecode_index"), g(2).alias("target_method"), g(3).try_cast("int").alias("bytecode_size"),
        (F.startswith(reason, F.lit("inline")) | F.contains(reason, F.lit("inlined"))).alias("inlined"), reason.alias("reason"),
    )


def parse_stacks(lines: DataFrame) -> DataFrame:
    """stack, count of collapsed stacks; blank lines, # comments and lines without a number go."""
    text = F.trim("line")
    out = lines.where((text != "") & ~F.startswith(text, F.lit("#"))).select(
        *_rest(lines), F.trim(F.regexp_extract(text, r"^(.*) (\S+)$", 1)).alias("stack"), F.regexp_extract(text, r"^(.*) (\S+)$", 2).try_cast("long").alias("count")
    )
    return out.where("stack <> '' and count is not null")
