"""Line-level de-duplication: a suffix array over line ids by prefix doubling, and the intervals of its common prefixes.

Native: DataFrame and SQL functions only.

Documents with equal texts are one text, that of the first of them; the others are copies line by line. Each non-blank line
becomes an id. A line that occurs once ends every repeated run, so the sequences worked on are stretches of
neighbouring repeated lines. Their suffixes are ranked by their first 1, 2, 4, ... ids: a class of suffixes has the number of
suffixes before it as its label, and splits by the labels found that many lines further on. A suffix that stands alone, or
whose stretch ended, is settled and leaves the rounds, which end when all are. The suffixes' order is then the suffix array.

Neighbouring classes of the array get the length of their longest common prefix from the labels of the rounds: the
longest power of two on which they agree, then the same behind it. Where neighbours share min_lines lines or more they form an
interval, all the copies of a repeated run; its first member stays and the later ones go.

Sums over the whole order are taken by range partition, plus one number a partition, so no task sees a whole class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.llm.common import Scratch, durable, sized, table

#: A run of this many lines is removed where it was seen before, and so is one line of so many characters.
MIN_LINES, MIN_CHARS = 2, 60
#: A distinct text: 128 bits of it. A place: a line of it.
TEXT, PLACE = ["th", "th2"], ["th", "th2", "at"]


def _hashes() -> list:
    """Rows of one doc_id with different texts are different documents; repeated rows are one."""
    return [F.xxhash64("text"), F.xxhash64(F.lit("text"), "text")]


def text_table(docs: DataFrame) -> DataFrame:
    """Distinct texts: th, th2, doc_id (the smallest, null first), n rows, lines (raw: number among all, h1, h2: 128 bits, chars) without blank ones."""
    lines = F.expr(
        "transform(filter(transform(split(text, '\\n'), (x, i) -> struct(i as raw, x as line)), x -> trim(x.line) <> ''), "
        "x -> struct(x.raw as raw, xxhash64(x.line) as h1, xxhash64('line', x.line) as h2, length(x.line) as chars))"
    )
    th, th2 = _hashes()
    one = docs.where("text is not null").select("doc_id", th.alias("th"), th2.alias("th2"), lines.alias("lines"))
    texts = one.groupBy(*TEXT).agg(F.min(F.struct("doc_id")).alias("own"), F.count("*").alias("n"), F.first("lines").alias("lines"))
    return texts.select(*TEXT, "own.doc_id", "n", "lines")


def _running(keep: Scratch, df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """df with the sum of value over all rows before, in the order of by, which no two rows share."""
    parts = keep(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("pid", F.spark_partition_id()))
    bases, total = [], 0
    for pid, part in sorted(parts.groupBy("pid").agg(F.sum(value)).collect()):  # a row a partition
        bases.append((pid, total))
        total += part
    known = F.broadcast(df.sparkSession.createDataFrame(bases, "pid int, base long"))
    before = Window.partitionBy("pid").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    return parts.join(known, "pid").withColumn(name, F.col("base") + F.coalesce(F.sum(value).over(before), F.lit(0))).drop("pid", "base")


def suffix_array(texts: DataFrame, keep: Scratch) -> DataFrame:
    """A row for each repeated line: its place, doc_id, raw, chars; seen: the line stands further up; rem: lines of its stretch from here on;

    labels: of its class after each round until it is settled; label: the last of them, which orders the suffixes; n: suffixes of that class.
    """
    lines = texts.select(*TEXT, "doc_id", F.posexplode("lines").alias("at", "l")).select(*PLACE, "doc_id", "l.*")
    classes = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", *PLACE)).alias("first")).where("n > 1")
    classes = sized(keep(_running(keep, classes, ["h1", "h2"], "n", "label")))
    seen = F.expr("not (first.th = th and first.th2 = th2 and first.at = at)").alias("seen")
    rows = lines.join(classes, ["h1", "h2"]).select(*PLACE, "doc_id", "raw", "chars", "label", "n", seen)
    rows = rows.withColumn("stretch", F.col("at") - F.row_number().over(Window.partitionBy(*TEXT).orderBy("at")))
    rem = F.max("at").over(Window.partitionBy(*TEXT, "stretch")) - F.col("at") + 1
    fixed = [*PLACE, "doc_id", "raw", "chars", "seen", "rem"]
    rows = keep(rows.withColumn("rem", rem).select(*fixed, "label", "n", F.array("label").alias("labels")))
    settled, step = [], 1
    while not rows.isEmpty():
        every = rows
        for s in settled:
            every = every.union(s)
        found = every.select(*TEXT, (F.col("at") - step).alias("at"), F.col("label").alias("found"))
        ahead = F.when(F.col("rem") > step, F.col("found")).otherwise(-1).alias("ahead")
        pairs = keep(rows.join(found, PLACE, "left").select(*fixed, "label", "labels", ahead))
        classes = keep(_running(keep, pairs.groupBy("label", "ahead").agg(F.count("*").alias("n")), ["label", "ahead"], "n", "before"))
        start = classes.groupBy("label").agg(F.min("before").alias("start"))
        classes = classes.join(start, "label").select("label", "ahead", "n", (F.col("label") + F.col("before") - F.col("start")).alias("fresh"))
        split = pairs.join(sized(keep(classes)), ["label", "ahead"])
        split = split.select(*fixed, F.col("fresh").alias("label"), "n", F.expr("concat(labels, array(fresh))").alias("labels"), F.expr("n = 1 or ahead = -1").alias("done"))
        split = keep(split)
        settled.append(split.where("done").drop("done"))
        rows, step = split.where("not done").drop("done"), 2 * step
    for s in settled:
        rows = rows.union(s)
    return rows


def _common(classes: DataFrame, suffixes: DataFrame, keep: Scratch) -> DataFrame:
    """label, lcp: of each class but the first, the number of lines that its suffixes and those of the class before it have in common."""

    agree = "size(filter(zip_with({0}, {1}, (x, y) -> x = y), x -> x)) - 1"
    one = lambda name, key: classes.select(key.alias("label"), F.struct(*PLACE, "rem").alias(name), F.col("labels").alias(f"{name}s"))
    pairs = one("a", F.col("label") + F.col("n")).join(one("b", F.col("label")), "label")
    pairs = pairs.select("label", "a", "b", F.expr(agree.format("`as`", "bs")).cast("int").alias("top"))
    pairs = keep(pairs.withColumn("lcp", F.expr("if(top < 0, 0, shiftleft(1, top))")))
    out = pairs.where("top < 1").select("label", "lcp")
    while not (pairs := pairs.where("top >= 1")).isEmpty():
        both = pairs.select("label", "lcp", F.explode(F.array("a", "b")).alias("s")).where("s.rem > lcp")
        both = both.select("label", "s.th", "s.th2", (F.col("s.at") + F.col("lcp")).alias("at")).join(suffixes.select(*PLACE, "labels"), PLACE)
        found = both.groupBy("label").agg(F.collect_list("labels").alias("two"))
        next_top = F.expr(f"if(size(two) = 2, least({agree.format('two[0]', 'two[1]')}, top - 1), -1)").cast("int")
        pairs = pairs.join(found, "label", "left").select("label", "a", "b", "lcp", F.coalesce(next_top, F.lit(-1)).alias("top"))
        pairs = keep(pairs.select("label", "a", "b", "top", F.expr("lcp + if(top < 0, 0, shiftleft(1, top))").alias("lcp")))
        out = out.union(pairs.where("top < 1").select("label", "lcp"))
    return out


def repeated_runs(texts: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """The place, doc_id, raw, chars and seen of each repeated line; length: of the longest repeated run that starts there; later: its first min_lines lines stand further up.

    A run is maximal, hence no part of the one that starts a line before, where that one's length is not greater.
    """
    keep = Scratch(texts.sparkSession)
    suffixes = keep(suffix_array(texts, keep))
    own = F.min(F.struct("doc_id", *PLACE, "rem", "labels")).alias("own")
    classes = keep(suffixes.groupBy("label", "n").agg(own).select("label", "n", "own.*"))
    lcp = keep(_common(classes, suffixes, keep))
    behind = lcp.select(F.col("label").alias("next"), F.col("lcp").alias("behind"))
    ranked = classes.join(lcp, "label", "left").join(behind, F.expr("next = label + n"), "left")
    length = F.expr("cast(greatest(coalesce(lcp, 0), coalesce(behind, 0), if(n > 1, rem, 0)) as long)").alias("length")
    cut = F.expr(f"if(coalesce(lcp, 0) < {min_lines}, 1L, 0L)").alias("cut")
    ranked = keep(_running(keep, ranked.select("label", "doc_id", *PLACE, length, cut), ["label"], "cut", "interval").withColumn("interval", F.col("interval") + F.col("cut")))
    firsts = ranked.groupBy("interval").agg(F.min(F.struct("doc_id", *PLACE)).alias("first"))
    ranked = keep(ranked.select("label", "length", "interval").join(firsts, "interval").select("label", "length", "first"))
    later = F.expr(f"length >= {min_lines} and not (first.th = th and first.th2 = th2 and first.at = at)").alias("later")
    runs = durable(suffixes.join(sized(ranked), "label").select(*PLACE, "doc_id", "raw", "chars", "seen", "length", later))
    keep.drop()
    return runs


def removed_lines(texts: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """th, th2, raw: the lines of distinct texts that belong to a later copy of a run."""
    runs = repeated_runs(texts, max(min_lines, 1))
    inside = runs.where("later").select(*TEXT, F.explode(F.expr(f"sequence(at, at + {max(min_lines, 1) - 1})")).alias("at")).distinct()
    # every line of a repeated run is itself a repeated line
    single = runs.where(F.col("seen") & (F.col("chars") >= min_chars))
    return single.select(*TEXT, "raw").union(runs.join(inside, PLACE, "left_semi").select(*TEXT, "raw"))


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with later copies of repeated line runs deleted, plus n_lines, n_removed.

    A run is min_lines consecutive non-blank lines, or one line of min_chars characters. Its first
    copy, by (doc_id, text hash, line), stays; a null doc_id comes first. Copies that overlap the
    first one count as later. Each distinct line stays at least once, where it first occurs.
    Blank lines are never compared and stay; they don't interrupt a run. Null text stays null with
    no lines; repeated rows with equal doc_id and text count once and all get the same text;
    columns named like the new ones are replaced; an empty table gives none.
    """
    texts = durable(text_table(docs))
    gone = removed_lines(texts.drop("n"), min_lines, min_chars).groupBy(*TEXT).agg(F.sort_array(F.collect_set("raw")).alias("gone"))
    own = docs.drop("n_lines", "n_removed", "_th", "_th2").withColumns({"_th": _hashes()[0], "_th2": _hashes()[1]})
    # of documents with one text the first has what was found, any other is a copy from its first line to its last
    repeated = sized(durable(texts.where("n > 1").select(*TEXT, F.col("doc_id").alias("first"))))
    same = own.where("text is not null").select("doc_id", F.col("_th").alias("th"), F.col("_th2").alias("th2")).distinct()
    copies = same.join(repeated, TEXT).where(~F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", *TEXT, F.lit(None).cast("array<int>"), F.lit(True))
    decided = texts.select("doc_id", *TEXT).join(gone, TEXT).select("doc_id", *TEXT, "gone", F.lit(False).alias("copy")).union(copies)
    joined = own.alias("d").join(decided.alias("g"), F.expr("d.doc_id <=> g.doc_id and d._th = g.th and d._th2 = g.th2"), "left")
    lines = "filter(transform(split(d.text, '\\n'), (x, i) -> struct(i as raw, x as line)), x -> trim(x.line) <> '')"
    every = f"transform(array({lines}), l -> transform(filter(l, x -> size(l) >= {min_lines} or length(x.line) >= {min_chars}), x -> x.raw))[0]"
    cut = joined.select("d.*", F.expr(f"if(g.copy, {every}, g.gone)").alias("_gone"))
    kept = "transform(array(split(text, '\\n')), l -> array_join(transform(array_except(sequence(0, size(l) - 1), _gone), i -> l[i]), '\\n'))[0]"
    text = F.expr(f"if(_gone is null, text, {kept})").alias("text")
    n_lines = F.coalesce(F.expr("size(filter(split(text, '\\n'), x -> trim(x) <> ''))"), F.lit(0))
    return cut.select(
        *[text if c == "text" else F.col(c) for c in own.columns if c not in ("_th", "_th2")],
        F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


OP6_SQL = f"""
with l as (
  select doc_id, text, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as raw
  from documents where text is not null
), n as (
  select *, row_number() over (partition by doc_id order by raw) as spot from l where trim(line, ' ') <> ''
), w as (
  select *, lead(line) over (partition by doc_id order by spot) as next,
    row_number() over (partition by line order by doc_id, spot) as nth from n
), p as (
  select *, row_number() over (partition by line, next order by doc_id, spot) as nth2 from w
), q as (
  select *, next is not null and nth2 > 1 as here, nth > 1 and length(line) >= {MIN_CHARS} as single from p
), g as (
  select doc_id, raw, here or single or coalesce(lag(here) over (partition by doc_id order by spot), false) as gone from q
), a as (
  select l.doc_id, string_agg(l.line, chr(10) order by l.raw) filter (where not coalesce(g.gone, false)) as text,
    count(g.raw) as n_lines, count(*) filter (where g.gone) as n_removed
  from l left join g on l.doc_id = g.doc_id and l.raw = g.raw group by l.doc_id
)
select d.doc_id, case when d.text is null then null else coalesce(a.text, '') end as text,
  coalesce(a.n_lines, 0) as n_lines, coalesce(a.n_removed, 0) as n_removed
from documents d left join a on d.doc_id = a.doc_id
"""
