"""Personal data: exact patterns, and terms that reveal them by corpus co-occurrence.

Native: DataFrame and SQL functions only.

A protected entity is a matched value (an e-mail address, an IP address, a card or phone number), the kind
of value, or personal data of any kind. Over the corpus, the pointwise mutual information of an entity e and
a term t of the same document is ln(n_te N / (n_t n_e)), and the information content of the entity ln(N / n_e),
with document counts n. Their difference is ln(n_te / n_t): how much of the entity the term gives away. A term
that gives away nearly all (n_te / n_t at `remove` or more) is removed wherever it occurs, one over `generalise`
is replaced by the class of what it gives away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.llm.common import durable, sized, table

KINDS = ("email", "ip", "card", "phone")
#: Possessive forms of the contract's patterns: the same leftmost matches, without recursion or retries on long runs.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for its kind's pattern to be tried at all.
HINTS = {"email": "contains(text, '@')", "ip": "rlike(text, '[0-9]\\\\.[0-9]')", "card": "rlike(text, '[0-9][ -]?[0-9]')", "phone": "rlike(text, '[+][0-9]')"}
#: Texts in which a term must stand with a value, or with a kind of values; shares from which a term is generalised or removed.
SUPPORT, KIND_SUPPORT, GENERALISE, REMOVE = 3, 20, 0.7, 0.95
#: A word, and what lies between words; terms are whole words of LETTERS characters on, one of them a letter.
WORD, GAPS, LETTERS = r"[\p{L}\p{M}\p{N}]+", r"[^\p{L}\p{M}\p{N}]+", 4
TERM, ANY = len(KINDS), len(KINDS)
KEY = ["doc_id", "th"]
SPAN = "struct<start: int, end: int, kind: int, value: string>"
TERM_SPAN = "struct<start: int, end: int, share: double, kind: int>"


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        part = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")
        return F.forall(F.split(value, "[.]"), lambda x: (F.length(part(x)) <= 3) & (F.coalesce(F.substring(part(x), 1, 3).try_cast("int"), F.lit(999)) <= 255))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "card":
        at = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.struct(c.try_cast("int").alias("d"), (i % 2 == 1).alias("twice")))
        add = lambda s, x: s + F.coalesce(F.when(x["twice"], x["d"] * 2 - F.when(x["d"] > 4, 9).otherwise(0)).otherwise(x["d"]), F.lit(0))
        fits = F.length(digits).between(14, 19)
        return fits & (F.aggregate(F.when(fits, at), F.lit(0), add) % 10 == 0)
    return F.lit(True)


def _pieces(kind: int, pattern: str) -> Column:
    """The matches of a pattern in `text`, each with its number and the length of the text since the one before."""
    found = F.arrays_zip(F.split("text", pattern, -1).alias("gap"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("m"))
    piece = lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("nth"), F.length(x["gap"]).alias("gap"), x["m"].alias("value"))
    return F.filter(F.transform(found, piece), lambda x: x["value"].isNotNull())


def _base_pieces(kind: str) -> Column:
    none = F.array().cast("array<struct<kind: int, nth: int, gap: int, value: string>>")
    return F.when(F.expr(HINTS[kind]), _pieces(KINDS.index(kind), PATTERNS[kind])).otherwise(none)


def _located(pieces: DataFrame) -> DataFrame:
    """doc_id, th, kind, start, end, value of rows doc_id, th, piece; a piece that comes twice counts once.

    Positions are running sums over a document's matches, so the work is linear in their number.
    """
    dealt = pieces.select(*KEY, "piece.*").repartition(*KEY, "kind")
    one = dealt.groupBy(*KEY, "kind", "nth").agg(F.first("gap").alias("gap"), F.first("value").alias("value"))
    before = Window.partitionBy(*KEY, "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    start = (F.coalesce(F.sum(F.col("gap") + F.length("value")).over(before), F.lit(0)) + F.col("gap")).cast("int")
    return one.withColumn("start", start).select(*KEY, "kind", "start", (F.col("start") + F.length("value")).alias("end"), "value")


def _is_valid() -> Column:
    cases = F.lit(False)
    for i, kind in enumerate(KINDS):
        cases = F.when(F.col("kind") == i, _valid(kind, F.col("value"))).otherwise(cases)
    return cases


def _texts_with_data(keyed: DataFrame) -> DataFrame:
    """doc_id, th, text, pieces: the documents with a valid match, and all matches in them."""
    held = keyed.select(*KEY, "text", *[_base_pieces(k).alias(f"p_{k}") for k in KINDS])
    valid = lambda kind: lambda x: _valid(kind, x["value"])
    some = [F.exists(f"p_{k}", valid(k)) for k in KINDS]
    return held.where(some[0] | some[1] | some[2] | some[3]).select(*KEY, "text", F.concat(*[f"p_{k}" for k in KINDS]).alias("pieces"))


def _terms_of(text: str) -> Column:
    """The distinct words of a text that may be terms; those of e-mail addresses are none."""
    plain = f"if(contains({text}, '@'), regexp_replace({text}, r'{PATTERNS['email']}', ' '), {text})"
    return F.expr(f"filter(array_distinct(split(lower({plain}), r'{GAPS}')), x -> length(x) >= {LETTERS} and rlike(x, r'\\p{{L}}'))")


def disclosing_terms(keyed: DataFrame, held: DataFrame, base: DataFrame, support: int = SUPPORT, kind_support: int = KIND_SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """term, share, kind: each term that gives an entity away, with its largest share and the kind of that entity (ANY: of any kind).

    held: the texts with personal data, base: their spans. Document frequencies are counted over all
    documents, repeated rows as often as they occur, partially in each task. A term's share of the documents with any personal data bounds
    its share of those with one entity; only terms that reach `generalise` by it are held against entities.
    """
    value = F.concat_ws(":", "kind", F.lower(F.regexp_replace("value", "[ ().-]+", ".")))
    level = lambda name, kind, entity: F.struct(F.lit(name).alias("level"), kind.alias("kind"), entity.alias("entity"))
    levels = F.array(level(0, F.col("kind"), value), level(1, F.col("kind"), F.lit("")), level(2, F.lit(ANY), F.lit("")))
    entities = durable(base.select(*KEY, F.explode(levels).alias("e")).select(*KEY, "e.*").distinct())
    least = F.when(F.col("level") == 0, support).otherwise(kind_support)
    often = entities.groupBy("level", "kind", "entity", "th").agg(F.lit(1).alias("one")).groupBy("level", "kind", "entity").agg(F.count("*").alias("texts")).where(F.col("texts") >= least)
    words = durable(held.select(*KEY, F.explode(_terms_of("text")).alias("term")).groupBy(*KEY, "term").agg(F.count("*").alias("rows")))
    inside = words.groupBy("term").agg(F.sum("rows").alias("m")).where(F.col("m") >= support)
    counted = keyed.select(F.explode(_terms_of("text")).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    able = counted.join(inside, "term").where(F.col("m") / F.col("n_t") >= generalise)
    able = durable(able.select("term", "n_t"))
    beside = words.join(sized(able.select("term")), "term")
    known = entities.join(sized(durable(often.select("level", "kind", "entity"))), ["level", "kind", "entity"])
    both = beside.alias("w").join(known.alias("e"), F.expr("w.doc_id <=> e.doc_id and w.th = e.th"))
    by_text = both.groupBy("e.level", "e.kind", "e.entity", "w.term", "w.th").agg(F.sum("w.rows").alias("n"))
    pairs = by_text.groupBy("level", "kind", "entity", "term").agg(F.sum("n").alias("n_te"), F.count("*").alias("texts")).where(F.col("texts") >= least)
    shares = pairs.join(sized(able), "term").withColumn("share", F.least(F.col("n_te") / F.col("n_t"), F.lit(1.0)))
    best = F.max(F.struct("share", (-F.col("level")).alias("close"), (-F.col("kind")).alias("kind"))).alias("best")
    strong = shares.where(F.col("share") >= generalise).groupBy("term").agg(best)
    return durable(strong.select("term", F.col("best.share").alias("share"), (-F.col("best.kind")).alias("kind")))


def _term_rows(keyed: DataFrame, strong: DataFrame) -> DataFrame:
    """doc_id, th, start, end, share, kind of every occurrence of the terms in all documents."""
    near = sized(strong)
    where = durable(keyed.select(*KEY, F.explode(_terms_of("text")).alias("term")).join(near.select("term"), "term", "left_semi").select(*KEY).distinct())
    texts = keyed.alias("d").join(sized(where).alias("w"), F.expr("d.doc_id <=> w.doc_id and d.th = w.th"), "left_semi")
    rows = _located(texts.select(*KEY, F.explode(_pieces(TERM, WORD)).alias("piece"))).drop("kind")
    return rows.withColumn("term", F.lower("value")).join(near, "term").select(*KEY, "start", "end", "share", "kind")


def _all_spans(keyed: DataFrame) -> DataFrame:
    """doc_id, th, spans, terms of the documents that have any, and cuts for sanitise()."""
    held = durable(_texts_with_data(keyed))
    base = durable(_located(held.select(*KEY, F.explode("pieces").alias("piece"))).where(_is_valid()))
    strong = disclosing_terms(keyed, held, base)
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    rows = base.select(*KEY, "start", "kind", "end", "value", null("double", "share"), null("int", "of"))
    if not strong.isEmpty():
        terms = _term_rows(keyed, strong)
        rows = rows.unionByName(terms.select(*KEY, "start", F.lit(TERM).alias("kind"), "end", null("string", "value"), "share", F.col("kind").alias("of")))
    dealt = rows.repartition(*KEY)
    before = Window.partitionBy(*KEY).orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    reached = dealt.withColumn("at", F.coalesce(F.max("end").over(before), F.lit(0)))
    every = reached.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "at", "value", "share", "of"))).alias("every"))
    own = lambda test, fields, kind: F.transform(F.filter("every", test), lambda x: F.struct(*[x[f].alias(g) for f, g in fields])).cast(f"array<{kind}>")
    return every.select(
        *KEY, "every",
        own(lambda x: x["kind"] < TERM, [(f, f) for f in ("start", "end", "kind", "value")], SPAN).alias("spans"),
        own(lambda x: x["kind"] == TERM, [("start", "start"), ("end", "end"), ("share", "share"), ("of", "kind")], TERM_SPAN).alias("terms"),
    )


def _with_spans(docs: DataFrame, columns: list[str]) -> DataFrame:
    """d: docs with th, k: what _all_spans finds in them."""
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    own = docs.withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    found = _all_spans(keyed).select(*KEY, *columns)
    return own.alias("d").join(found.alias("k"), F.expr("d.doc_id <=> k.doc_id and d.th = k.th"), "left")


def personal_data(docs: DataFrame) -> DataFrame:
    """docs plus spans (base) and terms (the method's), both arrays of code-point spans, end exclusive.

    Null text counts as empty; repeated rows get equal spans, and rows of one doc_id with different
    texts are told apart; a null doc_id is one like any other; extra columns pass through, save ones
    named spans, terms or th; an empty table gives none. The work on a text is linear in its length and
    its number of matches; only the table of matches and that of word counts are shuffled, and the texts
    with personal data written once.
    """
    own = docs.drop("spans", "terms", "th")
    text = F.coalesce("d.text", F.lit("")).alias("text")
    empty = F.array()
    return _with_spans(own, ["spans", "terms"]).select(
        *[text if c == "text" else F.col(f"d.{c}") for c in own.columns],
        F.coalesce("k.spans", empty.cast(f"array<{SPAN}>")).alias("spans"),
        F.coalesce("k.terms", empty.cast(f"array<{TERM_SPAN}>")).alias("terms"),
    )


def sanitise(docs: DataFrame, remove: float = REMOVE) -> DataFrame:
    """docs with personal data replaced in `text`: [EMAIL], [IP], [CARD], [PHONE]; terms by the class of
    what they give away, [EMAIL TERM] to [PHONE TERM] or [PERSONAL TERM], or, from `remove` on, by nothing.

    Of overlapping spans the one that starts first counts (then the kind listed first), and what
    another reaches beyond it is cut as well. Null text stays null; columns of any name stay; otherwise
    as personal_data.
    """
    held = {c: f"_held_{c}" for c in ("every", "chars", "th") if c in docs.columns}  # names that the search uses itself
    words = F.expr("array('[EMAIL]', '[IP]', '[CARD]', '[PHONE]')")
    classes = F.expr("array('[EMAIL TERM]', '[IP TERM]', '[CARD TERM]', '[PHONE TERM]', '[PERSONAL TERM]')")
    found = _with_spans(docs.withColumnsRenamed(held), ["every"])
    # the text as its code points, so that a slice costs its own length only
    cut = found.withColumn("chars", F.when(F.col("k.every").isNotNull(), F.split("d.text", "")))
    part = lambda lo, n: F.array_join(F.slice("chars", lo + 1, n), "")
    term = lambda x: F.when(x["share"] >= remove, "").otherwise(F.element_at(classes, x["of"] + 1))
    word = lambda x: F.when(x["kind"] < TERM, F.element_at(words, F.least(x["kind"], F.lit(TERM - 1)) + 1)).otherwise(term(x))
    fresh = F.filter("k.every", lambda x: x["start"] >= x["at"])
    reach = F.array_max(F.transform("k.every", lambda x: x["end"]))
    head = F.array_join(F.transform(fresh, lambda x: F.concat(part(x["at"], x["start"] - x["at"]), word(x))), "")
    clean = F.when(F.col("chars").isNull(), F.col("d.text")).otherwise(F.concat(head, part(reach, F.greatest(F.size("chars") - reach, F.lit(0)))))
    return cut.select(*[clean.alias("text") if c == "text" else F.col(f"d.{held.get(c, c)}").alias(c) for c in docs.columns])


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    name = F.expr("array('email', 'ip', 'card', 'phone', 'term')")
    show = lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"], s["end"])
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    short = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    terms = F.transform("terms", lambda t: F.struct(t["start"].alias("start"), F.lit(TERM).alias("kind"), t["end"].alias("end")))
    every = F.sort_array(F.concat(F.transform("spans", short), terms))
    return found.select(
        "doc_id", *[n(k) for k in KINDS],
        F.sha2(F.array_join(F.transform("spans", show), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform(every, show), ",").alias("spans"),
    )
