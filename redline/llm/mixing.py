"""Mixing sources to target weights by the cube method.

A source whose target is m times its words takes each text floor(m) times and
once more with probability m - floor(m). The flight phase moves those
probabilities along the null space of two constraints, documents and tokens, so
that both totals stay what they were; each step settles one text. Flights run in
groups of bounded size, what they leave (two texts each) flies again with its
like, and one landing of a dozen texts for each source ends it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from redline.llm.common import checkpointed, free_names

#: Texts that fly in one task, and texts of a source that are left for its landing: two of the flight, others of all sizes.
FLIGHT, FEW = 4_000, 12
#: Sources whose table is small enough to broadcast; more are joined by shuffle.
SMALL = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words between ASCII blanks; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``: words to take of each source.

    Sources by code point, null last, have ``weights`` in turn and share
    ``share`` times all words. A target stops at ``most`` times its source's
    words and the excess goes to the others by weight until none is above:
    in order of words per weight, a source is full if what is left by then
    would fill it. One row for each source passes through one task.
    """
    turn = F.array(*[F.lit(float(w)) for w in weights])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", F.get(turn, (F.row_number().over(by_name) - 1) % len(weights)))
    full = F.col("source_size") * F.lit(float(most))
    by_ratio = Window.orderBy(full / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(whole) * F.lit(float(share))
    left = total - F.coalesce(F.sum(full).over(before), F.lit(0.0))
    is_full = full * F.sum("weight").over(onward) <= F.col("weight") * left
    marked = ranked.withColumn("full", is_full).withColumn("all", total)
    level = (F.col("all") - F.coalesce(F.sum(F.when(F.col("full"), full)).over(whole), F.lit(0.0))) / F.sum(
        F.when(~F.col("full"), F.col("weight"))
    ).over(whole)
    return marked.select("source", "source_size", "n", F.when(F.col("full"), full).otherwise(F.col("weight") * level).alias("target"))


def flight(p: np.ndarray, size: np.ndarray, luck: np.ndarray) -> np.ndarray:
    """Probabilities of which all but two at most are 0 or 1, with the same sum and the same sum of p * size.

    Texts are taken in the given order, three at a time; ``luck`` holds a number
    in [0, 1) for each text, used when it joins.
    """
    out = p.tolist()
    sizes, luck = size.tolist(), luck.tolist()
    tiny, active = 1e-11, []
    for new, start in enumerate(out):
        if not tiny < start < 1 - tiny:
            out[new] = float(round(start))
            continue
        active.append(new)
        if len(active) < 3:
            continue
        i, j, k = active
        a, b, c = sizes[j] - sizes[k], sizes[k] - sizes[i], sizes[i] - sizes[j]
        if not (a or b or c):
            a, b, c = 1.0, -1.0, 0.0
        moves = [(x, d) for x, d in ((i, a), (j, b), (k, c)) if d]
        up = min((1 - out[x]) / d if d > 0 else out[x] / -d for x, d in moves)
        down = min(out[x] / d if d > 0 else (1 - out[x]) / -d for x, d in moves)
        step = up if luck[new] * (up + down) < down else -down
        for x, d in moves:
            out[x] += step * d
        active = []
        for x in (i, j, k):
            if tiny < out[x] < 1 - tiny:
                active.append(x)
            else:
                out[x] = float(round(out[x]))
        if len(active) == 3:  # rounding kept all three: the nearest to an end is settled
            x = min(active, key=lambda y: min(out[y], 1 - out[y]))
            out[x] = float(round(out[x]))
            active.remove(x)
    return np.array(out)


def landing(p: np.ndarray, size: np.ndarray, luck: np.ndarray) -> np.ndarray:
    """The small problem that is left (FEW fractions): of all roundings that which misses the totals least.

    The cost of a rounding is its error in tokens, then in documents, then how
    unlikely the draws ``luck`` make it, so that equal ones do not always fall alike.
    """
    bits = (np.arange(1 << len(p))[:, None] >> np.arange(len(p))) & 1
    off = np.abs(bits @ size - p @ size)
    count = np.abs(bits.sum(1) - p.sum())
    chance = np.abs(bits - (luck < p)).sum(1)
    return bits[np.lexsort((chance, count, off))[0]].astype(float)


def _fly(last: bool):
    def run(group: pa.Table) -> pa.Table:
        rows = group.sort_by([("size", "descending"), ("luck", "ascending"), ("key", "ascending")])
        size, luck, p = (rows[c].to_numpy().astype(float) for c in ("size", "luck", "p"))
        open_ = np.flatnonzero((p > 1e-11) & (p < 1 - 1e-11))
        held = open_[np.unique(np.linspace(0, len(open_) - 1, FEW - 2).astype(int))] if last and len(open_) else open_[:0]
        rest = np.setdiff1d(np.arange(len(p)), held)
        p[rest] = flight(p[rest], size[rest], luck[rest])
        if last:
            left = np.flatnonzero((p > 1e-11) & (p < 1 - 1e-11))
            p[left] = landing(p[left], size[left], luck[left])
        return rows.set_column(rows.schema.get_field_index("p"), "p", pa.array(p))

    return run


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
        weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 1) -> DataFrame:
    """How often each row of ``df`` is taken: key, source, size, source_size, target, copies, taken.

    ``taken`` is copies * size. The result depends on the rows' values alone:
    order and draws come from a hash of the key. Rows of one key are separate
    texts. A null text has 0 words; a source without words is taken once each.
    """
    base = checkpointed(df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{source}`").cast("string").alias("source"),
                                  words(F.col(f"`{text}`")).alias("size")))
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    aims = checkpointed(targets(sizes, weights, share, most))
    few = aims.count() <= SMALL
    facts = aims.withColumn("ratio", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(1.0))
    facts = facts.withColumnRenamed("source", "of")
    joined = base.join(F.broadcast(facts) if few else facts, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    luck = F.xxhash64(F.lit(seed), "key").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    rows = joined.select(
        "key", "source", "size", "source_size", "target", F.floor("ratio").cast("int").alias("whole"),
        (F.col("ratio") - F.floor("ratio")).alias("p"), luck.alias("luck"), "n",
    )
    settled, level = None, 0
    biggest = aims.agg(F.max("n")).first()[0] or 0
    while True:
        buckets = F.ceil(F.col("n") / FLIGHT)
        last = biggest <= FLIGHT
        grouped = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1 + level), "key"), buckets).cast("int"))
        flown = grouped.groupBy("source", "bucket").applyInArrow(_fly(last), grouped.schema).drop("bucket")
        if last:
            done = flown
        else:
            flown = checkpointed(flown)
            done = flown.where("p <= 1e-11 or p >= 1 - 1e-11")
            biggest = -(-biggest // FLIGHT) * 3  # what is left of a source: two of each group, and slack
            rows = flown.where("p > 1e-11 and p < 1 - 1e-11").withColumn("n", F.ceil(F.col("n") / FLIGHT) * 3)
        settled = done if settled is None else settled.unionByName(done)
        if last:
            break
        level += 1
    copies = (F.col("whole") + F.round("p")).cast("int")
    return settled.select("key", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def repeat(df: DataFrame, taken: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``df`` as often as ``taken`` (key, copies) says; rows of one key alike, by the most copies of it."""
    name, times = free_names(df, "__key", "__copies")
    often = taken.where("copies > 0").groupBy(F.col("key").alias(name)).agg(F.max("copies").alias(times))
    joined = df.join(often, F.col(f"`{key}`").eqNullSafe(F.col(name)))
    return joined.withColumn(times, F.explode(F.array_repeat(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in df.columns])
