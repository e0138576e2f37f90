"""MinHash near-duplicate documents with sequential Bayesian verification and exact confirmation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from redline.llm.common import Memo, checkpointed, map_texts, mix64
from redline.llm.near import band_keys, hash_family, link, minhash, shared_keys, sized

#: Bands and their rows: a pair of similarity 0.8 shares none with probability (1 - 0.8**6)**32 = 6e-5.
BANDS, ROWS = 32, 6

_family = hash_family(BANDS * ROWS)
_odd = mix64(np.arange(101, 151, dtype=np.uint64)) | np.uint64(1)


def word_hashes() -> Memo:
    """Hashes of words, remembered within a task."""
    return Memo(xxhash.xxh3_64_intdigest, 250_000)


def shingle_sets(texts: list[str | None], width: int, hashes: Memo) -> list[np.ndarray]:
    """Each text's distinct ``width``-word shingles as sorted 64-bit hashes.

    Words stand between ASCII blanks, A-Z lower-cased; fewer words than
    ``width`` are one shingle, none an empty set.
    """
    words = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    sizes = [len(w) for w in words]
    h = np.fromiter((hashes[w] for ws in words for w in ws), np.uint64, sum(sizes))
    whole = max(0, len(h) - width + 1)
    grams = np.zeros(whole, np.uint64)
    for i in range(width):
        grams += h[i : i + whole] * _odd[i]
    grams = mix64(grams)
    out, start = [], 0
    for n in sizes:
        if n >= width:
            out.append(np.unique(grams[start : start + n - width + 1]))
        elif n:
            short = (h[start : start + n] * _odd[:n]).sum(dtype=np.uint64) + np.uint64(n)
            out.append(mix64(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        start += n
    return out


def node_of(sets: list[np.ndarray]) -> np.ndarray:
    """A hash of each set; equal sets have equal ones."""
    return np.array([mix64(np.array([mix64(s).sum(dtype=np.uint64) ^ np.uint64(len(s))], np.uint64))[0] for s in sets], np.uint64)


def signed(df: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """key, tkey (hash of the text), n_shingles, node, sig, bands; the last three null for an empty set."""

    hashes = word_hashes()

    def kernel(texts: list[str | None]) -> list[pa.Array]:
        sets = shingle_sets(texts, width, hashes)
        sizes = np.array([len(s) for s in sets])
        some = np.flatnonzero(sizes)
        node, sig, bands = [None] * len(sets), [None] * len(sets), [None] * len(sets)
        if len(some):
            values = np.concatenate([sets[i] for i in some])
            ends = np.cumsum(sizes[some])
            minima = minhash(values, ends - sizes[some], ends, _family)
            keys = band_keys(minima, BANDS, ROWS)
            short = minima.astype(np.uint16)
            for i, nd, s, k in zip(some.tolist(), node_of([sets[i] for i in some]).view(np.int64).tolist(), short, keys, strict=True):
                node[i], sig[i], bands[i] = nd, s.tobytes(), k
        return [pa.array(sizes.astype(np.int64)), pa.array(node, pa.int64()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]

    rows = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"), F.xxhash64(text).alias("tkey"))
    return map_texts(rows, "text", "n_shingles long, node long, sig binary, bands array<long>", kernel, ["key", "tkey"])


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """key, n_shingles, component_id, kept for every row.

    Rows are linked if 100 * common >= percent * union of their shingle sets;
    candidates come from bands, survive sequential Bayesian pruning and are
    confirmed on full sets. ``component_id`` is the least key reachable, kept
    marks it. Rows with an empty set (null, empty or blank text) are linked with
    nothing. Rows of one key and one set are alike; null keys are no component's
    least key unless it has no other, and are kept then.
    """
    rows = checkpointed(signed(df, key, text, width))
    some = rows.where("node is not null")
    known: list[DataFrame] = []

    def signatures(nodes: DataFrame) -> DataFrame:
        """node, sig, and one row (text hash and key) that the node's text is read from again."""
        facts = some.join(sized(checkpointed(nodes)), "node").groupBy("node").agg(
            F.first("sig").alias("sig"), F.min(F.struct("tkey", "key")).alias("o")
        )
        known.append(checkpointed(facts.select("node", "sig", "o.tkey", "o.key")))
        return known[0].select("node", "sig")

    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = checkpointed(known[0].drop("sig").join(nodes, "node"))
        wanted = sized(wanted.select(F.col("node").alias("wanted"), F.col("tkey").alias("t"), F.col("key").alias("k")))
        texts = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
        match = (F.xxhash64("text") == F.col("t")) & F.col("key").eqNullSafe(F.col("k"))
        found = texts.join(wanted, match).select("wanted", "text")

        hashes = word_hashes()

        def kernel(batch: list[str | None]) -> list[pa.Array]:
            sets = shingle_sets(batch, width, hashes)
            return [pa.array(node_of(sets).view(np.int64)), pa.array([np.sort(s.view(np.int64)) for s in sets], pa.list_(pa.int64()))]

        made = map_texts(found, "text", "node long, set array<long>", kernel, ["wanted"]).where("wanted = node")
        return made.groupBy("node").agg(F.first("set").alias("set"))

    members = some.select("node", F.explode("bands").alias("key"))
    comps = link(shared_keys(members), sets_of, percent, signatures, BANDS * ROWS)
    light = rows.select("key", "n_shingles", "node")
    named = light.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = named.where("comp is not null").groupBy("comp").agg(F.min("key").alias("component_id"))
    alone = named.where("comp is null").withColumn("component_id", F.col("key")).select("key", "n_shingles", "component_id")
    grouped = named.join(least, "comp").select("key", "n_shingles", "component_id")
    out = grouped.unionByName(alone)
    return out.select(F.col("key").alias(key), "n_shingles", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))
