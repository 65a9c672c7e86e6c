"""A hidden Markov language model over word classes, and the add-one unigram score beside it.

Every word belongs to one class: the most frequent words have one each, every other word shares one
of BUCKETS by its CRC-32, and the end of a text is a class. The latent states emit classes; within a
shared class a word has its add-one share of the class's training tokens. So the model gives every
text a probability, unseen words included, while its parameters keep a fixed size; the counts of
words, which grow with the corpus, stay distributed.

Training: Baum-Welch over whole texts; each task sums the expected counts of its texts, Spark adds them up, and
the driver sees one table of states x classes a round. The first model's states are far apart and seldom left, so
that a text's words add up in favour of one of them; rounds end when the likelihood hardly grows. Long texts are
worked on in segments side by side, joined exactly by the product of the moves through each.
Scoring: the scaled forward recursion over whole texts.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm.common import durable, small, table
from ferrule.llm.langid import held_out
from ferrule.llm.simhash import LOWER

OWN, BUCKETS, STATES, SEGMENT = 4096, 1024, 6, 128
#: Rounds at most; training ends before if the log10 likelihood of a token gains less than GAIN. How likely a state of the first model stays.
ROUNDS, GAIN, STAY = 3, 0.004, 0.98
#: Words whose counts every task holds; the counts of all others are joined.
NEAR = 1 << 16
#: The key of the end of a text; no word holds a line feed.
END = b"\n"


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(LOWER).split() if text else []


def word_counts(docs: DataFrame) -> DataFrame:
    """word binary, c: tokens of all texts, each text's end among them; each task adds up first, in bounded memory."""

    def count(batches):
        held: Counter = Counter()

        def out():
            rows = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "c"])
            held.clear()
            return rows

        for batch in small(batches):
            for text in batch.column(0).to_pylist():
                held.update(words(text))
                held[END] += 1
                if len(held) > 300_000:
                    yield out()
        yield out()

    return docs.select("text").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """The near words with their counts, and tokens and words of each shared class."""

    def __init__(self, near: list[tuple[bytes, int]], shared: dict[int, tuple[int, int]]):
        self.index = _Index({w: i for i, (w, _) in enumerate(near)})
        self.counts = np.array([c for _, c in near], np.int64)
        own = np.arange(len(near))
        bucket = np.array([OWN + zlib.crc32(w) % BUCKETS for w, _ in near], np.int64).reshape(-1)
        self.symbol = np.where(own < OWN, own, bucket)
        self.norm = np.zeros(BUCKETS)
        for b in range(BUCKETS):
            n, v = shared.get(b, (0, 0))
            self.norm[b] = np.log10(n + v + 1)


class _Index(dict):
    def __missing__(self, key):
        return -1


ENCODED = "rid long, doc_id long, train boolean, n_tokens long, known long, near_log double, shared_log double, symbols binary, far string"


def encode(docs: DataFrame, vocabulary: Vocabulary, train) -> DataFrame:
    """Each text as class symbols, with what the near words settle of its scores and its far words in a line each."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)  # NEAR words at most

    def run(batches):
        v, part, n = held.value, TaskContext.get().partitionId(), 0
        logs = np.append(np.log10(v.counts + 1.0), 0.0)
        for batch in small(batches):
            rows = []
            for doc, text, training in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                w = words(text)
                at = np.fromiter(map(v.index.__getitem__, w), np.int64, len(w))
                symbols = np.append(v.symbol, 0)[at] if len(v.counts) else np.zeros(len(w), np.int64)
                gone = np.flatnonzero(at < 0)
                far = [w[i] for i in gone.tolist()]
                if far:
                    symbols[gone] = [OWN + zlib.crc32(x) % BUCKETS for x in far]
                shared = symbols >= OWN
                log = logs[at]
                norm = v.norm[symbols[shared] - OWN].sum()
                symbols = np.append(symbols, OWN + BUCKETS).astype("<u2").tobytes()
                rows.append((part << 33 | n, doc, training, len(w) + 1, len(w) - len(far), log.sum(), log[shared].sum() - norm, symbols, b"\n".join(far).decode()))
                n += 1
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.string()]
            names = [x.split()[0] for x in ENCODED.split(", ")]
            columns = zip(*rows, strict=True) if rows else [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.select("doc_id", "text", train.alias("train")).mapInArrow(run, ENCODED)


class Hmm:
    """start (K), moves (K x K), emits (classes x K)."""

    def __init__(self, start: np.ndarray, moves: np.ndarray, emits: np.ndarray):
        self.start, self.moves, self.emits = start, moves, emits

    @classmethod
    def first(cls, unigram: np.ndarray, states: int = STATES, seed: int = 7) -> Hmm:
        rng = np.random.default_rng(seed)
        p = (unigram + 0.5) / (unigram + 0.5).sum()
        emits = p[:, None] * (0.05 + rng.exponential(size=(len(p), states)))
        moves = np.full((states, states), (1 - STAY) / max(states - 1, 1))
        np.fill_diagonal(moves, STAY if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), moves, emits / emits.sum(0))

    def log10(self, texts: list[np.ndarray]) -> np.ndarray:
        """The exact log10 likelihood of whole symbol sequences; texts still running at a step are one matrix."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        n = np.array([len(texts[i]) for i in order], np.int64)
        out = np.zeros(len(texts))
        if not len(n) or not n[0]:
            return out
        joined = np.concatenate([texts[i] for i in order]).astype(np.int64)
        at = np.cumsum(n) - n
        running = np.searchsorted(-n, -np.arange(n[0]), side="left")  # with more than t symbols
        p, log = None, np.zeros(len(n))
        for t in range(int(n[0])):
            k = int(running[t])
            p = (self.start if p is None else p[:k] @ self.moves) * self.emits[joined[at[:k] + t]]
            c = p.sum(axis=1)
            p /= c[:, None]
            log[:k] += np.log10(c)
        out[order] = log
        return out

    def _through(self, blocks: list, count: int, many: np.ndarray) -> np.ndarray:
        """Per segment, if of a text with many, the product of its moves and emissions, up to a factor: state before it x state at its end."""
        size = len(self.start)
        out = np.empty((count, size, size))
        for which, obs, running, top in blocks:
            if many[which].any():
                m = np.where(top[:, None, None], self.start, self.moves) * self.emits[obs[0]][:, None, :]
                for t, k in enumerate(running.tolist()):
                    if t:
                        m[:k] = (m[:k].reshape(-1, size) @ self.moves).reshape(k, size, size) * self.emits[obs[t, :k]][:, None, :]
                    if t % 8 == 7 or t + 1 == len(running):
                        m /= m.sum(axis=(1, 2), keepdims=True)
                out[which] = m
        return out

    def _joined(self, blocks: list, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each segment the distribution of the state before it, and how likely the rest of its text is by the state at its end."""
        k, count = len(self.start), int(parts.sum())
        before, after = np.full((count, k), 1 / k), np.ones((count, k))
        if parts.max(initial=1) > 1:
            through, first = self._through(blocks, count, np.repeat(parts > 1, parts)), np.cumsum(parts) - parts
            for j in range(1, int(parts.max())):
                at = first[parts > j] + j
                x = (before[at - 1, None, :] @ through[at - 1])[:, 0]
                before[at] = x / x.sum(axis=1, keepdims=True)
            for j in range(int(parts.max()) - 1, 0, -1):
                at = first[parts > j] + j
                x = (through[at] @ after[at, :, None])[:, :, 0]
                after[at - 1] = x / x.max(axis=1, keepdims=True)
        return before, after

    def expected(self, texts: list[np.ndarray], segment: int = SEGMENT) -> np.ndarray:
        """Expected counts of starts, moves and emissions over whole texts, flattened; then their log10 likelihood and number of symbols."""
        k, v = len(self.start), len(self.emits)
        starts, moves, emits, log = np.zeros(k), np.zeros((k, k)), np.zeros((k, v)), 0.0
        texts = [t for t in texts if len(t)]
        cut = [(t[i : i + segment], i == 0) for t in texts for i in range(0, len(t), segment)]
        parts = np.array([-(-len(t) // segment) for t in texts], np.int64)
        alone = np.repeat(parts == 1, parts)
        order, blocks = np.array(sorted(range(len(cut)), key=lambda i: (-len(cut[i][0]), alone[i])), np.int64), []
        for lo in range(0, len(cut), 1024):
            which = order[lo : lo + 1024]
            n = np.array([len(cut[i][0]) for i in which], np.int64)
            obs = np.zeros((int(n[0]), len(which)), np.int64)
            for j, i in enumerate(which):
                obs[: n[j], j] = cut[i][0]
            running = np.searchsorted(-n, -np.arange(n[0]), side="left")  # with more than t symbols
            blocks.append((which, obs, running, np.array([cut[i][1] for i in which])))
        before, after = self._joined(blocks, parts)
        for which, obs, running, top in blocks:
            e = self.emits[obs]
            alpha, scale = np.empty_like(e), np.ones(obs.shape)
            alpha[0] = np.where(top[:, None], self.start, before[which] @ self.moves) * e[0]
            for t, m in enumerate(running.tolist()):
                if t:
                    alpha[t, :m] = (alpha[t - 1, :m] @ self.moves) * e[t, :m]
                scale[t, :m] = alpha[t, :m].sum(axis=1)
                alpha[t, :m] /= scale[t, :m, None]
            n = (np.arange(len(obs))[:, None] < np.searchsorted(-running, -np.arange(len(which)), side="left")).sum(axis=0)
            beta = after[which] / (alpha[n - 1, np.arange(len(which))] * after[which]).sum(axis=1, keepdims=True)
            log += np.log10(scale).sum()
            for t in range(len(running) - 1, -1, -1):
                m = int(running[t])
                gamma = alpha[t, :m] * beta[:m]
                gamma /= gamma.sum(axis=1, keepdims=True)
                ahead = e[t, :m] * beta[:m] / scale[t, :m, None]
                if t:
                    moves += self.moves * (alpha[t - 1, :m].T @ ahead)
                    beta[:m] = ahead @ self.moves.T
                else:
                    moves += self.moves * (before[which][~top].T @ ahead[~top])
                    starts += gamma[top].sum(axis=0)
                alpha[t, :m] = gamma
            flat = np.concatenate([obs[t, :m] for t, m in enumerate(running.tolist())])
            g = np.concatenate([alpha[t, :m] for t, m in enumerate(running.tolist())])
            for s in range(k):
                emits[s] += np.bincount(flat, weights=g[:, s], minlength=v)
        return np.concatenate([starts, moves.ravel(), emits.ravel(), [log, sum(map(len, texts))]])

    def updated(self, counts: np.ndarray, unigram: np.ndarray) -> Hmm:
        k, v = len(self.start), len(self.emits)
        starts, moves, emits = counts[:k], counts[k : k + k * k].reshape(k, k), counts[k + k * k : k + k * k + k * v].reshape(k, v)
        prior = (unigram + 0.5) / (unigram + 0.5).sum()
        starts, moves, emits = starts + 0.1, moves + 0.1, emits.T + prior[:, None]
        return Hmm(starts / starts.sum(), moves / moves.sum(1, keepdims=True), emits / emits.sum(0))


def train(encoded: DataFrame, unigram: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Hmm:
    """Baum-Welch over all training texts; what reaches the driver has the size of the model."""
    model, size, last = Hmm.first(unigram, states), states + states * states + states * len(unigram) + 2, -np.inf
    sc = encoded.sparkSession.sparkContext
    for _ in range(rounds):
        held = sc.broadcast(model)

        def expect(batches, held=held):
            total = np.zeros(size)
            for batch in small(batches, 1024):
                total += held.value.expected([np.frombuffer(b, "<u2") for b in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["i", "x"])

        rows = encoded.where("train").select("symbols").mapInArrow(expect, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
        counts = np.zeros(size)
        for i, x in rows:
            counts[i] = x
        model = model.updated(counts, unigram)
        now = counts[-2] / max(counts[-1], 1)
        if now - last < GAIN:
            break
        last = now
    return model


def score(docs: DataFrame, training) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    training: boolean column, which rows to learn from (null: not). Null and empty texts are their
    end alone; repeated rows are scored alike and train as often as they occur; a null doc_id is
    carried along; other columns are ignored; without training rows every word is unknown; an
    empty table gives no rows.
    """
    training = F.coalesce(training, F.lit(False))
    counts = durable(word_counts(docs.where(training)))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).head()
    ends = (counts.where(F.col("word") == F.lit(END)).head() or (None, 0))[1]
    # words by eighths of a power of two of their count: whole steps from the top, so that nothing is sorted or cut
    step, real = F.floor(F.log2("c") * 8), F.col("word") != F.lit(END)
    sizes = counts.where(real).groupBy(step.alias("s")).count().orderBy(F.desc("s")).collect()  # 8 x 63 rows at most
    lowest, held_words = None, 0
    for s, m in sizes:
        if held_words + m > NEAR:
            break
        lowest, held_words = s, held_words + m
    is_near = F.lit(False) if lowest is None else step >= lowest
    near = sorted(((bytes(w), c) for w, c in counts.where(real & is_near).collect()), key=lambda x: (-x[1], x[0]))
    shared_words = counts.where(real)
    if near:
        w, c = near[min(OWN, len(near)) - 1]
        shared_words = shared_words.where((F.col("c") < c) | ((F.col("c") == c) & (F.col("word") > F.lit(w))))
    bucket = (F.crc32("word") % BUCKETS).alias("bucket")
    shared = {b: (c, m) for b, c, m in shared_words.groupBy(bucket).agg(F.sum("c"), F.count("*")).collect()}
    vocabulary = Vocabulary(near, shared)
    unigram = np.zeros(OWN + BUCKETS + 1)
    np.add.at(unigram, np.arange(min(OWN, len(near))), vocabulary.counts[:OWN])
    for b, (c, _) in shared.items():
        unigram[OWN + b] = c
    unigram[-1] = ends
    encoded = durable(encode(docs, vocabulary, training))
    held = docs.sparkSession.sparkContext.broadcast(train(encoded, unigram))
    log_n, log_end = float(np.log10(n + v + 1)), float(np.log10(ends + 1))

    def forward(batches):
        for batch in small(batches, 2048):
            x = held.value.log10([np.frombuffer(b, "<u2") for b in batch.column(batch.num_columns - 1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(x)], [*batch.schema.names[:-1], "path"])

    names = ["rid", "doc_id", "train", "n_tokens", "known", "near_log", "shared_log"]
    kinds = ENCODED.split(", ")[:7]
    scored = encoded.select(*names, "symbols").mapInArrow(forward, ", ".join([*kinds, "path double"]))
    own = scored.select("rid", "doc_id", "n_tokens", "known", "near_log", "shared_log", "path")
    rest = counts.where(real & ~is_near).select(F.col("word").cast("string").alias("word"), "c")
    each = encoded.where("far <> ''").select("rid", F.explode(F.split("far", "\n")).alias("word"))
    far = each.join(rest, "word").groupBy("rid").agg(F.sum(F.log10(F.col("c") + 1.0)).alias("far_log"), F.count("*").alias("far_known"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return own.join(far, "rid", "left").select(
        "doc_id", "n_tokens", (F.col("known") + zero("far_known") + int(ends > 0)).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("near_log") + zero("far_log") + log_end - F.col("n_tokens") * log_n).alias("base_score"),
        (F.col("path") + F.col("shared_log") + zero("far_log")).alias("score"),
    )


def op9_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, ~held_out(7, 2))
    return scored.select("doc_id", held_out(7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
