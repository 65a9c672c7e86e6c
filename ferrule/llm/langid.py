"""Language identification by nearest centroid over normalised TF-IDF character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.llm.common import bound_batches, durable, sized, small, table

DIMS = 1 << 13
#: Labelled documents a language lends to the centroids at most; document frequencies use all.
SAMPLE = 400
CENTROIDS = 3
_LETTERS: list = []


def _letters() -> np.ndarray:
    """code point -> lower-case code point, 0 for what is no letter."""
    if not _LETTERS:
        lut = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                lut[c] = ord(low) if len(low) == 1 else c
        _LETTERS.append(lut)
    return _LETTERS[0]


def grams(texts: list[str | None], dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """(counts of hashed letter bigrams and trigrams by text, whether a text has a letter).

    Runs of other characters count as one space; a text is taken as a whole, in any length.
    """
    raw = [np.frombuffer((t or "").encode("utf-32-le"), np.uint32) for t in texts]
    gap = np.zeros(1, np.uint32)
    codes = np.concatenate([x for r in raw for x in (gap, r)] + [gap])
    owner = np.repeat(np.arange(len(raw)), [len(r) + 1 for r in raw])
    owner = np.append(owner, max(len(raw) - 1, 0))
    low = _letters()[codes]
    keep = (low > 0) | np.append(True, low[:-1] > 0)
    # a text's own first gap stays, so that no gram spans two texts unnoticed
    low, owner = low[keep], owner[keep]
    has = np.zeros(len(raw), bool)
    has[owner[low > 0]] = True
    a, b, c = low[:-2], low[1:-1], low[2:]
    two = (a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA6B)) & np.uint32(0xFFFFFFFF)
    three = two * np.uint32(0xC2B2AE35) ^ c * np.uint32(0x27D4EB2F)
    fold = lambda h: ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(8)).astype(np.int64) % dims
    same = owner[:-2] == owner[2:]
    letter2, letter3 = same & ((a > 0) | (b > 0)), same & (b > 0)
    at = np.concatenate([owner[:-2][letter2] * dims + fold(two[letter2]), owner[:-2][letter3] * dims + fold(three[letter3])])
    return np.bincount(at, minlength=len(raw) * dims).reshape(len(raw), dims).astype(np.float32), has


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def _blocks(texts: list, chars: int = 150_000, rows: int = 48):
    """Slices of the list with bounded rows and characters (one text at least)."""
    i = 0
    while i < len(texts):
        n, j = 0, i
        while j < len(texts) and j - i < rows and (j == i or n + len(texts[j] or "") <= chars):
            n += len(texts[j] or "")
            j += 1
        yield i, j
        i = j


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from spread starting points; fewer centroids where there are fewer distinct rows."""
    centres = [x.mean(axis=0)]
    far = np.full(len(x), np.inf)
    for _ in range(k - 1):
        far = np.minimum(far, 1 - x @ (centres[-1] / max(np.linalg.norm(centres[-1]), 1e-12)))
        if far.max() <= 1e-6:
            break
        centres.append(x[int(far.argmax())])
    c = np.array(centres)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        own = (x @ c.T).argmax(axis=1)
        c = np.array([x[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


class Model:
    """idf, the centroids, the language of each and the similarity under which each rejects."""

    def __init__(self, idf: np.ndarray, centroids: np.ndarray, langs: list[str], floors: np.ndarray):
        self.idf, self.centroids, self.langs, self.floors = idf, centroids, langs, floors

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        out: list[tuple[str, float, bool]] = []
        for i, j in _blocks(texts):
            counts, has = grams(texts[i:j])
            sims = weigh(counts, self.idf) @ self.centroids.T
            best = sims.argmax(axis=1) if len(self.langs) else np.zeros(j - i, int)
            grown = np.minimum(1, np.sqrt(counts.sum(axis=1) / 400))
            for n, (b, h) in enumerate(zip(best, has, strict=True)):
                if not h or not self.langs:
                    out.append(("und", 0.0, True))
                else:
                    s = float(min(max(sims[n, b], 0.0), 1.0))
                    out.append((self.langs[b], s, bool(s < self.floors[b] * grown[n])))
        return out


def fit(labelled: DataFrame, dims: int = DIMS, sample: int = SAMPLE, k: int = CENTROIDS) -> Model:
    """labelled(doc_id, text, lang) -> Model.

    Document frequencies count every labelled text. Centroids come from the `sample` texts of each
    language with the smallest hash of doc_id (ties by doc_id; rows of one doc_id count as one), clustered
    language by language. A centroid rejects below half of the similarity that 99
    of 100 of its own sample texts reach (for long texts; the floor falls with the root of the
    length below 400 grams). Null texts and null languages are left out; without labelled rows
    every prediction is `und`.
    """
    bound_batches(labelled.sparkSession)
    labelled = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")

    def frequencies(batches):
        df, n = np.zeros(dims, np.int64), 0
        for batch in small(batches):
            texts = batch.column(0).to_pylist()
            for i, j in _blocks(texts):
                counts, _ = grams(texts[i:j], dims)
                df += (counts > 0).sum(axis=0)
                n += j - i
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dims)), pa.array(np.append(n, df))], ["gram", "df"])

    rows = labelled.select("text").mapInArrow(frequencies, "gram long, df long").groupBy("gram").agg(F.sum("df")).collect()
    df = np.zeros(dims + 1)
    for gram, n in rows:
        df[gram + 1] = n
    idf = (np.log((1 + df[0]) / (1 + df[1:])) + 1).astype(np.float32)
    # the first `sample` rows of each of 16 shares of a language, and of these the first: at most 16 x sample rows of a language meet
    first = lambda df, *by: df.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("h", "doc_id"))).where(F.col("nth") <= sample)
    hashed = labelled.select("lang", "doc_id", F.xxhash64("doc_id").alias("h")).distinct()
    picked = durable(first(first(hashed, "lang", F.expr("pmod(h, 16)")), "lang").select("lang", "doc_id", "nth"))
    chosen = labelled.join(sized(picked), ["lang", "doc_id"]).select("lang", "nth", "text")

    def vectors(batches):
        for batch in small(batches, 64):
            texts = batch.column(2).to_pylist()
            x = [v.tobytes() for i, j in _blocks(texts) for v in weigh(grams(texts[i:j], dims)[0], idf)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.binary())], ["lang", "nth", "vector"])

    def clusters(t: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(t.sort_by([("nth", "ascending"), ("vector", "ascending")]).column("vector").to_pylist()), np.float32).reshape(t.num_rows, -1)
        c = cluster(x, k)
        sims = x @ c.T
        own = sims.argmax(axis=1)
        floors = [0.5 * float(np.quantile(near, 0.01)) if len(near := sims[own == i, i]) else 0.0 for i in range(len(c))]
        columns = [pa.array([t.column("lang")[0].as_py()] * len(c)), pa.array(range(len(c)), pa.int32()), pa.array([v.astype(np.float32).tobytes() for v in c], pa.binary()), pa.array(floors, pa.float64())]
        return pa.Table.from_arrays(columns, ["lang", "i", "centroid", "floor"])

    # a language's vectors are `sample` of them, whatever the corpus; what comes to the driver is its centroids
    found = chosen.mapInArrow(vectors, "lang string, nth int, vector binary").groupBy("lang").applyInArrow(clusters, "lang string, i int, centroid binary, floor double")
    rows = sorted(found.collect(), key=lambda r: (r.lang, r.i))
    centroids = np.array([np.frombuffer(r.centroid, np.float32) for r in rows]) if rows else np.zeros((0, dims), np.float32)
    return Model(idf, centroids, [r.lang for r in rows], np.array([r.floor for r in rows]))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs plus lang_pred, score, rejected; only `text` is an input.

    Null, empty and letterless texts are `und` with score 0 and rejected; repeated rows are
    predicted alike; other columns pass through, and ones named like the three new ones are
    replaced; an empty table gives none. A batch holds texts in blocks of bounded size.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # dims x centroids, of fixed size

    @F.arrow_udf("struct<lang_pred: string, score: double, rejected: boolean>")
    def predict(text: pa.Array) -> pa.Array:
        out = [r for at in range(0, len(text), 512) for r in shared.value.predict(text[at : at + 512].to_pylist())]
        columns = list(zip(*out, strict=True)) if out else [()] * 3
        kinds = (pa.string(), pa.float64(), pa.bool_())
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["lang_pred", "score", "rejected"])

    named = docs.drop("lang_pred", "score", "rejected").withColumn("_p", predict("text"))
    return named.select(*[c for c in named.columns if c != "_p"], "_p.lang_pred", "_p.score", "_p.rejected")


def held_out(mod: int, rest: int, key: str = "doc_id"):
    """crc32(key as text) mod `mod` is `rest`."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % mod == rest


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(4, 2)))
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", "rejected"
    )

