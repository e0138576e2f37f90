"""Language identification: multinomial naive Bayes over hashed character n-grams.

Fitting counts n-grams of a bounded, hash-chosen sample of labelled texts; the
log-probability matrix (languages x buckets) is broadcast, and whole texts are
scored in numpy batches: one gather per language and one segmented sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from redline.llm.common import map_texts, runs, unit_hash, without

ORDERS = (1, 2, 3)
UNKNOWN = "und"
#: Most bytes of the broadcast matrix; with more languages the buckets are halved until it fits.
MATRIX_BYTES = 64 << 20


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # languages x (buckets + 1), float32; the last bucket weighs nothing
    prior: np.ndarray


_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """A flag for each code point: is it a letter of Unicode category L?"""
    if not _letters:
        _letters.append(np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), np.uint8).astype(bool))
    return _letters[0]


def ngrams(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each n-gram (``buckets``: none), row by order; where each text starts; which have a letter.

    Letters are lower-cased, all else counts as one blank kind; n-grams without
    a letter, or over the end of a text, get no bucket.
    """
    lowered = [t.lower() + " " for t in texts]
    starts = np.concatenate(([0], np.cumsum([len(t) for t in lowered]))).astype(np.int64)
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[codes]
    codes = np.where(is_letter, codes, 32).astype(np.uint32)
    n, made = len(codes), np.full((len(ORDERS), len(codes)), buckets, np.int32)
    last = starts[1:] - 1
    for row, order in enumerate(ORDERS):
        if n < order:
            continue
        h, some = np.full(n - order + 1, order, np.uint32), np.zeros(n - order + 1, bool)
        for k in range(order):
            h = (h ^ codes[k : n - order + 1 + k]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            some |= is_letter[k : n - order + 1 + k]
        made[row, : n - order + 1] = np.where(some, h % np.uint32(buckets), buckets)
        for back in range(order - 1):
            made[row, np.maximum(last - back, starts[:-1])] = buckets
    has = np.add.reduceat(is_letter, starts[:-1], dtype=np.int64) > 0
    return made, starts, has


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
        per_lang: int = 3000, buckets: int = 1 << 15, most_langs: int = 1000) -> Model:
    """A model of the ``most_langs`` commonest languages in ``lang``, from at most about ``per_lang`` texts of each.

    The sample is the rows whose hash of ``key`` falls under per_lang / rows of
    the language: the same rows each time, whole texts, no row cap. Rows whose
    text or language is null teach nothing; without any row the model is empty.
    """
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    counted = rows.groupBy(lang).agg(F.count("*").alias("n")).orderBy(F.desc("n"), lang).limit(most_langs)
    sizes = {r[lang]: r["n"] for r in counted.collect()}
    langs = sorted(sizes)
    while buckets > 1024 and len(langs) * buckets * 4 > MATRIX_BYTES:
        buckets //= 2
    if not langs:
        return Model([], np.zeros((0, buckets + 1), np.float32), np.zeros(0))
    share = F.create_map(*[F.lit(x) for name in langs for x in (name, per_lang / sizes[name])])
    sample = rows.where(unit_hash(F.col(key), seed=2) < share[F.col(lang)]).select(lang, text)
    at = {name: i for i, name in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(at), buckets + 1), np.int64)
        for batch in batches:
            for a, b in runs(batch.column(1)):
                part = batch.slice(a, b - a)
                grams, starts, _ = ngrams(part.column(1).to_pylist(), buckets)
                of = np.repeat([at[x] for x in part.column(0).to_pylist()], np.diff(starts))
                for row in grams:
                    total += np.bincount(of * (buckets + 1) + row, minlength=total.size).reshape(total.shape)
        total[:, buckets] = 0
        lang_at, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (lang_at.astype(np.int32), bucket.astype(np.int32), total[lang_at, bucket])],
            names=["l", "b", "n"],
        )

    counted = sample.mapInArrow(count, "l int, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n"))
    got = counted.toArrow()  # at most languages x buckets rows
    counts = np.zeros((len(langs), buckets))
    counts[got["l"].to_numpy(), got["b"].to_numpy()] = got["n"].to_numpy()
    logp = np.log((counts + 0.05) / (counts.sum(1, keepdims=True) + 0.05 * buckets))
    weights = np.array([sizes[x] for x in langs], float)
    blank = np.zeros((len(langs), 1))
    return Model(langs, np.hstack([logp, blank]).astype(np.float32), np.log(weights / weights.sum()))


def predict(df: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``df`` with the likeliest language of each whole text and its posterior probability.

    A null text, one without a letter, or an empty model gives ``und`` and 0.
    Equal likelihoods go to the smaller name. Columns of these names are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def kernel(texts: list[str | None]) -> list[pa.Array]:
        m = shared.value
        if not m.langs:
            return [pa.array([UNKNOWN] * len(texts)), pa.array(np.zeros(len(texts)))]
        grams, starts, has = ngrams([t or "" for t in texts], m.logp.shape[1] - 1)
        sums = np.empty((len(m.langs), len(texts)))
        for i, logp in enumerate(m.logp):
            each = logp.take(grams[0])
            for row in grams[1:]:
                each += logp.take(row)
            sums[i] = np.add.reduceat(each, starts[:-1], dtype=np.float64) + m.prior[i]
        best = sums.argmax(0)
        odds = np.exp(sums - sums.max(0)).sum(0)
        names = [m.langs[b] if ok else UNKNOWN for b, ok in zip(best, has, strict=True)]
        return [pa.array(names, pa.string()), pa.array(np.where(has, 1 / odds, 0.0))]

    return map_texts(df, text, f"`{lang}` string, `{score}` double", kernel, without(df, lang, score))


