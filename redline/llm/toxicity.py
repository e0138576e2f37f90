"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are present or absent, so a long text is no more toxic than a
short one of the same words. L1 leaves few weights, which are broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from redline.llm.common import Memo, give_back, map_texts, runs, unit_hash, without

BITS = 20
_word = re.compile(r"\w+")


def word_hashes() -> Memo:
    """Hashes of words, remembered within a task."""
    return Memo(xxhash.xxh32_intdigest, 250_000)


@dataclass
class Model:
    """Non-zero weights by bucket; at most 2**BITS."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.buckets] = self.weights
        return out


def features(texts: list[str], hashes: Memo) -> tuple[list[np.ndarray], np.ndarray, int]:
    """Buckets of words, of word pairs and of pairs that skip a word, over all texts; each word's text; texts."""
    words = [_word.findall(t.lower()) for t in texts]
    of = np.repeat(np.arange(len(texts)), [len(w) for w in words])
    h = np.fromiter((hashes[w] for ws in words for w in ws), np.uint64, len(of))
    shift = np.uint64(64 - BITS)
    out = [(h * np.uint64(0x9E3779B97F4A7C15)) >> shift]
    for gap, odd in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9)):
        both = (h[:-gap] * np.uint64(odd) + h[gap:]) * np.uint64(0x9E3779B97F4A7C15) >> shift
        both[of[:-gap] != of[gap:]] = 1 << BITS  # over the end of a text: no feature
        out.append(both)
    return [x.astype(np.int64) for x in out], of, len(texts)


def _sets(texts: list[str], hashes: Memo) -> list[np.ndarray]:
    parts, of, n = features(texts, hashes)
    pairs = np.unique(np.concatenate([(of[: len(p)] << 21) | p for p in parts]))
    pairs = pairs[(pairs & ((1 << 21) - 1)) < 1 << BITS]
    return np.split((pairs & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(pairs >> 21, np.arange(1, n)))


def train(sets: list[np.ndarray], labels: list[int], alpha: float = 2.0, beta: float = 1.0, l1: float = 12.0,
          l2: float = 0.1, epochs: int = 10, positive: float = 3.0) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal, a text at a time with per-coordinate rates: buckets and weights other than 0, bias.

    A text of label 1 counts ``positive`` times.
    """
    z, n, bias, bias_n = np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for at, y in zip(sets, labels, strict=True):
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            g = (1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - y) * (positive if y else 1.0)
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[at] = ni + g * g
            bias_n += g * g
            bias -= alpha * g / (beta + np.sqrt(bias_n))
    w = weights(z, n)
    at = np.flatnonzero(w)
    return at, w[at], bias


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "label", key: str = "doc_id",
        per_class: tuple[int, int] = (10000, 6000)) -> Model:
    """A model from about ``per_class`` texts labelled 0 and 1 at most.

    ``docs`` has ``key`` and ``text``, ``labels`` has ``key`` and ``label``. The
    sample is the labels whose hash of ``key`` falls under a share by class,
    the same each time; features are made where the rows are, and one task
    trains over the bounded sample in hash order. The bias is set back for the
    shares. Rows with a null text or another label teach nothing; without both
    classes each text gets the share of label 1 (0.5 without any). A key's label
    counts once, however often it is repeated; of both labels each counts.
    """
    marks = labels.where(F.col(label).isin(0, 1)).select(
        F.col(key).alias("__k"), F.col(label).cast("int").alias("y"), unit_hash(F.col(key), seed=8).alias("u")
    ).distinct()
    sizes = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        known = sizes.get(1, 0.5 if not sizes else 0)
        odds = {0.5: 0.0}.get(known, 8.0 if known else -8.0)
        return Model(np.zeros(0, np.int64), np.zeros(0), odds)
    share = [min(1.0, per_class[y] / sizes[y]) for y in (0, 1)]
    # the sample of labels is bounded by per_class, so it goes to the texts
    chosen = marks.where(F.col("u") < F.when(F.col("y") == 1, share[1]).otherwise(share[0]))
    texts = docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("t")).where("t is not null")
    sample = texts.join(F.broadcast(chosen), F.col("__key") == F.col("__k")).select("y", "t", "u")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for batch in batches:
            for a, b in runs(batch.column(1)):
                part = batch.slice(a, b - a)
                sets = _sets(part.column(1).to_pylist(), hashes)
                made = pa.array([s.tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), made], names=["y", "u", "f"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, labels = [], []
        for batch in batches:
            labels += batch.column(0).to_pylist()
            sets += [np.frombuffer(x, np.int32) for x in batch.column(2).to_pylist()]
        at, w, bias = train(sets, labels)
        sets.clear()
        give_back()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1)), pa.array(np.append(w, bias))], names=["b", "w"]
        )

    made = sample.mapInArrow(featurise, "y int, u double, f binary")
    got = made.repartition(1).sortWithinPartitions("u", "f").mapInArrow(learn, "b long, w double").toArrow()
    b, w = got["b"].to_numpy(), got["w"].to_numpy()
    bias = float(w[b < 0][0]) + float(np.log(share[0] / share[1]))
    return Model(b[b >= 0], w[b >= 0], bias)


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the probability of label 1 of each whole text; null or empty texts get the bias alone."""
    shared, state = df.sparkSession.sparkContext.broadcast(model), {}

    def kernel(texts: list[str | None]) -> list[pa.Array]:
        if not state:
            state["w"], state["hashes"] = np.append(shared.value.dense(), np.float32(0)), word_hashes()
        w, hits = state["w"], []
        parts, of, n = features([t or "" for t in texts], state["hashes"])
        for part in parts:
            some = np.flatnonzero(w[part])
            hits.append((of[some] << 21) | part[some])
        found = np.unique(np.concatenate(hits))
        total = np.bincount(found >> 21, w[found & ((1 << 21) - 1)], minlength=n) + shared.value.bias
        return [pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))]

    return map_texts(df, text, f"`{out}` double", kernel, without(df, out))
