"""Quality: a linear-chain conditional random field over the lines of a text.

Each line has features of itself and of its two neighbours. The chain's
forward-backward marginals say how likely each line is good; weighted by line
length they add up to the text's score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from redline.llm.common import map_texts, runs, unit_hash, without

#: Kinds of code points that are counted in each line.
LOWER, UPPER, DIGIT, BLANK, STOP, BAR, OTHER = range(7)
OWN = 16
WIDTH = 3 * OWN + 1
_kinds: list[np.ndarray] = []
_address = re.compile(r"https?://|www\.|@\w+\.|\d{3}[-. ]\d{4}")


@dataclass
class Model:
    """Weights of the emission (good against bad) and the 2 x 2 transition scores; a few hundred bytes."""

    emission: np.ndarray
    transition: np.ndarray
    mean: np.ndarray
    scale: np.ndarray


def kinds() -> np.ndarray:
    if not _kinds:
        table = np.full(0x110000, OTHER, np.uint8)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                table[c] = UPPER if s.isupper() else LOWER
            elif s.isdigit():
                table[c] = DIGIT
            elif s.isspace():
                table[c] = BLANK
        for s in ".,;:!?'\"":
            table[ord(s)] = STOP
        for s in "|\t{}[]<>=*_":
            table[ord(s)] = BAR
        _kinds.append(table)
    return _kinds[0]


def own_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row for each line of the texts, the text of each line, the length of each line (1 at least)."""
    split = [t.split("\n") for t in texts]
    lines = [line for ls in split for line in ls]
    of = np.repeat(np.arange(len(texts)), [len(ls) for ls in split])
    sizes = np.array([len(x) for x in lines])
    kind = kinds()[np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)]
    at = np.repeat(np.arange(len(lines)), sizes)
    count = np.bincount(at * 7 + kind, minlength=7 * len(lines)).reshape(-1, 7).astype(float)
    words = [x.split() for x in lines]
    n_words = np.array([len(w) for w in words], float)
    distinct = np.array([len(set(w)) for w in words], float)
    again = np.array([sum(a == b for a, b in zip(w, w[1:], strict=False)) for w in words], float)
    seen = [Counter(ls) for ls in split]
    times = np.array([c[x] for c, ls in zip(seen, split, strict=True) for x in ls], float)
    first = np.array([x[:1].isupper() for x in lines], float)
    ends = np.array([x.rstrip()[-1:] in (".", "!", "?", "…", "。") for x in lines], float)
    address = np.array([bool(_address.search(x)) for x in lines], float)
    n, w = np.maximum(sizes, 1), np.maximum(n_words, 1)
    own = np.column_stack([
        *(count / n[:, None]).T, np.log1p(n_words), np.log1p(sizes / w), distinct / w, again / w,
        np.log(times) * (n_words > 0), first, ends, address, (sizes == 0),
    ])
    return own, of, n


def with_neighbours(own: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Own features, those of the previous and of the next line of the same text (0 at its ends), and 1."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    same = (of[1:] == of[:-1])[:, None]
    before[1:] = own[:-1] * same
    after[:-1] = own[1:] * same
    return np.hstack([own, before, after, np.ones((len(own), 1))])


def marginals(good: np.ndarray, transition: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward in log space over all chains at once, a position at a time.

    ``good``: the score of state 1 of each line (state 0: 0). Returns each
    line's probability of state 1, each chain's log-partition, and the expected
    count of each transition in each chain.
    """
    sizes = np.bincount(of, minlength=n)
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    order = np.argsort(-sizes, kind="stable")
    emit = np.column_stack([np.zeros(len(good)), good])
    alpha, beta = emit.copy(), np.zeros_like(emit)
    deep = int(sizes.max(initial=0))
    alive = np.searchsorted(-sizes[order], -np.arange(deep), side="left")  # chains longer than a position
    for t in range(1, deep):
        at = starts[order[: alive[t]]] + t
        step = alpha[at - 1][:, :, None] + transition
        alpha[at] += np.logaddexp(step[:, 0], step[:, 1])
    for t in range(deep - 1, 0, -1):
        at = starts[order[: alive[t]]] + t
        step = transition + (emit[at] + beta[at])[:, None, :]
        beta[at - 1] = np.logaddexp(step[:, :, 0], step[:, :, 1])
    last = starts + sizes - 1
    logz = np.logaddexp(alpha[last, 0], alpha[last, 1])
    p = np.exp(alpha[:, 1] + beta[:, 1] - logz[of])
    inner = np.flatnonzero(of[1:] == of[:-1]) + 1
    pair = alpha[inner - 1][:, :, None] + transition + (emit[inner] + beta[inner])[:, None, :] - logz[of[inner]][:, None, None]
    counts = np.zeros((n, 2, 2))
    np.add.at(counts, of[inner], np.exp(pair))
    return np.clip(p, 0, 1), logz, counts


def train(own: np.ndarray, of: np.ndarray, labels: np.ndarray, weight: np.ndarray, rounds: int = 150, l2: float = 2e-3) -> Model:
    """Maximum likelihood of the chains whose lines all bear their text's label; weights by class; Adam over all chains."""
    x = with_neighbours(own, of)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    mean[-1], scale[-1] = 0, 1
    x = (x - mean) / scale
    n, y = len(labels), labels[of]
    w, tr = np.zeros(WIDTH), np.zeros((2, 2))
    lines = np.bincount(of, minlength=n)
    real = np.zeros((n, 2, 2))
    real[np.arange(n), labels, labels] = lines - 1
    # a chain counts as one text however many lines it has
    share = weight / lines / weight.sum()
    m, v = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    for t in range(1, rounds + 1):
        p, _, counts = marginals(x @ w, tr, of, n)
        gw = x.T @ ((p - y) * share[of]) + l2 * np.append(w[:-1], 0)
        gt = ((counts - real) * share[:, None, None]).sum(0) + l2 * tr
        g = np.concatenate([gw, gt.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, tr = w - step[:WIDTH], tr - step[WIDTH:].reshape(2, 2)
    return Model(w, tr, mean, scale)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "label", key: str = "doc_id",
        per_class: tuple[int, int] = (2500, 3500)) -> Model | float:
    """A model from about ``per_class`` texts labelled 0 and 1 at most, chosen by hash of ``key``.

    Line features are made on the executors; what the driver gets is bounded
    by ``per_class``. Rows with a null text or another label teach nothing;
    without both classes the result is the share of label 1 (0.5 without any). A
    key's label counts once, however often it is repeated; of both each counts.
    Very long texts are handled one at a time.
    """
    marks = labels.where(F.col(label).isin(0, 1)).select(
        F.col(key).alias("__k"), F.col(label).cast("int").alias("y"), unit_hash(F.col(key), seed=4).alias("u")
    ).distinct()
    sizes = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return float(1 in sizes) if sizes else 0.5
    share = [min(1.0, per_class[y] / sizes[y]) for y in (0, 1)]
    # the sample of labels is bounded by per_class, so it goes to the texts
    chosen = marks.where(F.col("u") < F.when(F.col("y") == 1, share[1]).otherwise(share[0]))
    texts = docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("t")).where("t is not null")
    sample = texts.join(F.broadcast(chosen), F.col("__key") == F.col("__k")).select("y", "t", "u")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in runs(batch.column(1)):
                part = batch.slice(a, b - a)
                own, of, _ = own_features(part.column(1).to_pylist())
                cuts = np.searchsorted(of, np.arange(1, len(part)))
                made = pa.array([x.astype(np.float32).tobytes() for x in np.split(own, cuts)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), made], names=["y", "u", "f"])

    got = sample.mapInArrow(featurise, "y int, u double, f binary").toArrow().sort_by([("u", "ascending"), ("f", "ascending")])
    own = [np.frombuffer(x, np.float32).reshape(-1, OWN) for x in got["f"].to_pylist()]
    labels = got["y"].to_numpy().astype(int)
    of = np.repeat(np.arange(len(own)), [len(x) for x in own])
    seen = np.array([(sizes[y]) / max(1, (labels == y).sum()) for y in (0, 1)])  # back to the classes' shares
    return train(np.concatenate(own).astype(float), of, labels, seen[labels])


def score(df: DataFrame, model: Model | float, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the length-weighted share of good lines of each whole text (a null text counts as empty)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def kernel(texts: list[str | None]) -> list[pa.Array]:
        m = shared.value
        if isinstance(m, float):
            return [pa.array(np.full(len(texts), m))]
        own, of, length = own_features([t or "" for t in texts])
        x = (with_neighbours(own, of) - m.mean) / m.scale
        p, _, _ = marginals(x @ m.emission, m.transition, of, len(texts))
        return [pa.array(np.bincount(of, p * length, len(texts)) / np.bincount(of, length, len(texts)))]

    return map_texts(df, text, f"`{out}` double", kernel, without(df, out))
