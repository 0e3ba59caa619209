"""Quality classifier: a convolutional network over bytes, in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Within a chunk learned filters, eight bytes wide
and moved by four, run over learned byte vectors; each filter's largest response in the chunk is kept. The document's
features are the mean and the maximum of these over its chunks, and a logistic layer combines them into one probability.

The network is fitted on the driver to a bounded sample of labelled rows: at most ``rows`` of each label in hash order, and
as many of them as hold half of ``chars`` characters by label. The labels' true proportions are restored by weights. Scoring is one
pass over the table; a batch holds at most 256 rows and is convolved 64 chunks at a time.

Defined cases: a null text scores as an empty one, which is one chunk of padding; repeated rows are scored each; labels that
are null or neither 0 nor 1 are not learned from; without labels of both kinds every score is the share of label 1, or 0.5
without any; where every sampled text of a label is above its share of characters, fitting raises; a null id is not held out and never learned from; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grovemark.llm.common import small_batches, table

CHUNK, STRIDE, PAD = 512, 4, 256
STEP = CHUNK - STRIDE  # chunks overlap so that no window is lost between them
#: Bounds of the sample that the network is fitted to: rows of each label, characters in all.
SAMPLE_ROWS, SAMPLE_CHARS = 1200, 12_000_000


def chunks(text: bytes) -> np.ndarray:
    """All overlapping chunks of a text, the last one padded."""
    n = max(1, -(-(len(text) - STRIDE) // STEP))
    flat = np.full((n - 1) * STEP + CHUNK, PAD, np.int16)
    flat[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.as_strided(flat, (n, CHUNK), (STEP * flat.itemsize, flat.itemsize))


@dataclass
class ByteNet:
    vectors: np.ndarray  # (257, d): of bytes and of padding
    filters: np.ndarray  # (STRIDE * d, 2 f): first and second half of each window
    bias: np.ndarray  # (f,)
    head: np.ndarray  # (2 f,)
    offset: np.ndarray  # (1,)

    @classmethod
    def new(cls, d: int = 8, f: int = 24, seed: int = 7) -> ByteNet:
        r = np.random.default_rng(seed)
        vectors = r.normal(0, 0.5, (257, d)).astype(np.float32)
        vectors[PAD] = 0
        return cls(vectors, r.normal(0, (STRIDE * d) ** -0.5, (STRIDE * d, 2 * f)).astype(np.float32), np.zeros(f, np.float32), r.normal(0, 0.1, 2 * f).astype(np.float32), np.zeros(1, np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.vectors, self.filters, self.bias, self.head, self.offset]

    def responses(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x: (n, CHUNK). The blocks' vectors (n, blocks, STRIDE * d) and the windows' responses (n, windows, f)."""
        f = len(self.bias)
        blocks = self.vectors[x].reshape(len(x), CHUNK // STRIDE, -1)
        halves = blocks @ self.filters
        out = halves[:, :-1, :f] + halves[:, 1:, f:]
        out += self.bias
        return blocks, out

    def pooled(self, x: np.ndarray, at_once: int = 64) -> np.ndarray:
        """Each chunk's largest response of each filter, not below zero."""
        return np.concatenate([np.maximum(self.responses(x[i : i + at_once])[1].max(axis=1), 0) for i in range(0, len(x), at_once)])

    def scores(self, texts: Sequence[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        cut = [chunks(t) for t in texts]
        count = np.array([len(c) for c in cut])
        start = np.concatenate([[0], np.cumsum(count)[:-1]])
        p = self.pooled(np.concatenate(cut))
        features = np.concatenate([np.add.reduceat(p, start) / count[:, None], np.maximum.reduceat(p, start)], axis=1)
        return 1 / (1 + np.exp(-np.clip((features @ self.head + self.offset).astype(np.float64), -30, 30)))


def fit(texts: Sequence[bytes], labels: Sequence[int], weights: Sequence[float], steps: int = 500, batch: int = 48, rate: float = 0.008, decay: float = 1e-4, seed: int = 7) -> ByteNet:
    """Adam on the weighted logistic loss; the gradient goes to the window and the chunk that each maximum came from."""
    net, rng = ByteNet.new(seed=seed), np.random.default_rng(seed)
    f, d = len(net.bias), net.vectors.shape[1]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parts()]
    cut, y, w, step = [chunks(t) for t in texts], np.asarray(labels, np.float32), np.asarray(weights, np.float32), 0
    total = steps
    while step < total:
        order = rng.permutation(len(cut))
        for lo in range(0, len(order), batch):
            take = order[lo : lo + batch]
            count = np.array([len(cut[i]) for i in take])
            doc = np.repeat(np.arange(len(take)), count)
            start = np.concatenate([[0], np.cumsum(count)[:-1]])
            x = np.concatenate([cut[i] for i in take])
            where, best = [], []
            for i in range(0, len(x), 64):
                r = net.responses(x[i : i + 64])[1]
                where.append(r.argmax(axis=1))
                best.append(r.max(axis=1))
            at, raw = np.concatenate(where), np.concatenate(best)
            p = np.maximum(raw, 0)
            top = np.maximum.reduceat(p, start)
            features = np.concatenate([np.add.reduceat(p, start) / count[:, None], top], axis=1)
            logit = features @ net.head + net.offset
            slope = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[take]) * w[take] / w[take].sum()).astype(np.float32)
            to_features = slope[:, None] * net.head[None, :]
            first = p == top[doc]  # ties share; they are rare but for zeros, which pass nothing on
            g = to_features[doc, :f] / count[doc, None] + to_features[doc, f:] * first
            g *= raw > 0
            rows = np.arange(len(x))[:, None]
            spots = at[:, :, None] * STRIDE + np.arange(2 * STRIDE)  # byte positions of each winning window
            bytes_at = x[rows[:, :, None], spots]  # (n, f, 8)
            seen = net.vectors[bytes_at]  # (n, f, 8, d)
            by_filter = (g.T[:, None, :] @ seen.reshape(len(x), f, -1).transpose(1, 0, 2)).reshape(f, 2 * STRIDE, d)
            to_filters = np.concatenate([by_filter[:, :STRIDE].reshape(f, -1).T, by_filter[:, STRIDE:].reshape(f, -1).T], axis=1)
            halves = np.concatenate([net.filters[:, :f].T.reshape(f, STRIDE, d), net.filters[:, f:].T.reshape(f, STRIDE, d)], axis=1)
            to_vectors = np.zeros_like(net.vectors)
            live = np.nonzero(g)
            which, pull = bytes_at[live].ravel(), (g[live][:, None, None] * halves[live[1]]).reshape(-1, d)
            for k in range(d):
                to_vectors[:, k] = np.bincount(which, pull[:, k], 257)
            to_vectors[PAD] = 0
            grads = [to_vectors, to_filters, g.sum(axis=0), features.T @ slope + decay * net.head, np.array([slope.sum()], np.float32)]
            step += 1
            now = rate * (1 - step / total) + 1e-4
            for part, grad, (m, v) in zip(net.parts(), grads, moments, strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                part -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def held_out(c: Column) -> Column:
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_to_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> ByteNet | float:
    """The fitted network, or the constant score where there is nothing to tell apart."""
    usable = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).where("__y in (0, 1) and __id is not null")
    usable = usable.where(~held_out(F.col("__id"))).distinct()
    counts = {r["__y"]: r["n"] for r in usable.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return float(next(iter(counts), 0.5))
    drawn = None
    for y in (0, 1):
        part = usable.where(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(rows)
        drawn = part if drawn is None else drawn.unionByName(part)
    # At most 2 * rows ids.
    met = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__t")).join(F.broadcast(drawn), "__id")
    order = [F.xxhash64("__id"), F.col("__id"), F.col("__n")]
    narrow = met.withColumn("__n", F.length("__t")).orderBy(*order).limit(2 * rows)
    # Each label has half the characters; its long texts come last, and one above its share is left out alone.
    share = chars // 2
    upto = F.sum("__n").over(Window.partitionBy("__y").orderBy(F.col("__n") > share // 2, *order).rowsBetween(Window.unboundedPreceding, 0))
    kept = narrow.where(F.col("__n") <= share).withColumn("__upto", upto).where(F.col("__upto") <= share)
    sample = [(r["__t"].encode("utf-8", "replace"), r["__y"]) for r in kept.orderBy(*order).select("__t", "__y", "__id").collect()]
    found = {y: sum(k == y for _, k in sample) for y in (0, 1)}
    if not all(found.values()):
        if narrow.select("__y").distinct().count() == 2:
            raise ValueError(f"every sampled text of a label has over {share} characters")
        return counts[1] / (counts[0] + counts[1])
    return fit([t for t, _ in sample], [y for _, y in sample], [counts[y] / found[y] for _, y in sample])


def score(docs: DataFrame, model: ByteNet | float, text_col: str = "text", name: str = "score") -> DataFrame:
    """The table with one more column, the probability of label 1. The model is a fixed 40 kB and travels with the task."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            if isinstance(model, float):
                yield pd.Series(np.full(len(s), model))
            else:
                yield pd.Series(model.scores([t.encode("utf-8", "replace") if isinstance(t, str) else b"" for t in s]))

    return docs.withColumn(name, scored(F.col(text_col).cast("string")))


def drop_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that score at least threshold, with their columns."""
    model = fit_to_labels(docs, labels, id_col, text_col)
    return score(docs, model, text_col, "__score").where(F.col("__score") >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs.select("doc_id", "text"), fit_to_labels(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
