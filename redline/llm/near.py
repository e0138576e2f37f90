"""Near-duplicate search over MinHash bands: candidates, Bayesian verification, components.

Items have a ``node`` (a 64-bit hash of their content, so copies are one node),
a signature and band keys. Every pair that shares a band is a candidate, yet no
bucket is expanded into its pairs: each node meets the least node of its
buckets first; only buckets that still hold several components are compared
within, in blocks, pairs of one component are never looked at, and what comes
out is a forest of links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from redline.llm.common import checkpointed, clean_up, give_back, mix64

#: Signature positions compared at a time, members of a bucket that meet in one task.
BATCH, BLOCK = 32, 1024
#: Links that one task joins (some 100 bytes each); nodes whose ids are broadcast (some 40 bytes each).
FEW_LINKS, LOOKUP = 1_500_000, 400_000


def hash_family(k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """k functions x -> (x ^ c) * a of 32-bit hashes, a odd."""
    r = mix64(np.arange(1, 2 * k + 1, dtype=np.uint64) + np.uint64(seed << 20)) >> np.uint64(32)
    return r[:k].astype(np.uint32) | np.uint32(1), r[k:].astype(np.uint32)


def minhash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The k minima of each range [start, end) of 64-bit hashes; ranges may overlap, none is empty."""
    x = (values >> np.uint64(32)).astype(np.uint32)
    x = np.append(x, np.uint32(0xFFFFFFFF))
    apart = bool(np.all(ends[:-1] == starts[1:])) if len(starts) else True
    at = starts if apart else np.column_stack([starts, ends]).ravel()
    out = np.empty((len(starts), len(family[0])), np.uint32)
    for i, (a, c) in enumerate(zip(*family, strict=True)):
        h = (x ^ c) * a
        if apart:
            h = h[: ends[-1]] if len(ends) else h
            out[:, i] = np.minimum.reduceat(h, at)
        else:
            out[:, i] = np.minimum.reduceat(h, at)[::2]
    return out


def band_keys(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """An int64 key for each item and band, of ``rows`` minima each."""
    out = np.empty((len(minima), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(minima), b + 1, np.uint64)
        for i in range(b * rows, (b + 1) * rows):
            key = mix64(key ^ minima[:, i].astype(np.uint64))
        out[:, b] = key
    return out.view(np.int64)


def least_matches(similarity: float, length: int, miss: float) -> list[tuple[int, int]]:
    """For each batch end n the fewest matches m that keep a pair.

    With a uniform prior the similarity after m of n matches is Beta(m + 1,
    n - m + 1); a pair goes when it reaches ``similarity`` with probability
    under ``miss``. The tail is a binomial sum: P(Beta > t) = P(Bin(n+1, t) <= m).
    """
    out = []
    for n in [*range(BATCH, length, BATCH), length]:
        logs = np.cumsum(np.concatenate(([0.0], np.log(np.arange(1, n + 2)))))
        i = np.arange(n + 2)
        tail = np.cumsum(np.exp(logs[n + 1] - logs[i] - logs[n + 1 - i] + i * np.log(similarity) + (n + 1 - i) * np.log(1 - similarity)))
        out.append((n, int(np.argmax(tail[: n + 1] >= miss))))
    return out


def survivors(a: np.ndarray, b: np.ndarray, plan: list[tuple[int, int]]) -> np.ndarray:
    """Indices of the row pairs that no batch of their signatures rules out."""
    alive, matches, done = np.arange(len(a)), np.zeros(len(a), int), 0
    for n, least in plan:
        matches = matches + (a[alive, done:n] == b[alive, done:n]).sum(1)
        keep = matches >= least
        alive, matches, done = alive[keep], matches[keep], n
    return alive


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def components(links: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """node, comp: the least node reachable by links (a, b), for every node that has a link.

    Up to ``few`` links, which is checked, are joined in one task. More go
    through large-star and small-star in turn until the stars stay the same;
    minima are combined before they are dealt out, and each round is checkpointed.
    """
    if links.count() <= few:
        return links.select("a", "b").repartition(1).mapInArrow(_joined, "node long, comp long")
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges, sign = checkpointed(edges), None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if sign == (now["n"], now["x"]) or not now["n"]:
            break
        sign = now["n"], now["x"]
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = checkpointed(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        edges = checkpointed(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
    comp = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp"))
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("comp", F.col("node"))
    return comp.unionByName(roots).groupBy("node").agg(F.min("comp").alias("comp"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Roots are hooked on lesser roots along all links at once, and paths cut short, until nothing changes."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
    nodes, at = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    left, right = np.split(at, 2)
    root = np.arange(len(nodes))
    while True:
        p, q = root[left], root[right]
        apart = p != q
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
        while (root[root] != root).any():
            root = root[root]
    for i in range(0, len(nodes), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 100_000]), pa.array(nodes[root[i : i + 100_000]])], names=["node", "comp"])


def shared_keys(members: DataFrame) -> DataFrame:
    """node, key, hub (the key's least node), own (SEVERAL) and apart (true), each once, of the keys that several nodes have."""
    hubs = members.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("other")).where("hub <> other")
    found = members.join(hubs.select("key", "hub"), "key").select("node", "key", "hub").distinct()
    return checkpointed(found.withColumn("own", F.lit(SEVERAL)).withColumn("apart", F.lit(True)))


#: Stands for several owners; an owner of this very number only makes more candidates.
SEVERAL = -(1 << 63)


def shared_buckets(members: DataFrame) -> DataFrame:
    """node, key, hub, own and apart of the keys that nodes of different owners have; key and hub are null for a repeated node.

    ``members``: key, node and own, the document that has the node (or SEVERAL);
    rows can repeat. A key's two low bits are the number of its band. ``hub`` is
    the key's least node; ``own`` is SEVERAL for nodes of several owners;
    ``apart``: node and hub are not in one and the same document alone. Nodes of
    several owners come once more without key and hub, whether or not they meet
    others. Members are dealt out once, and a bucket passes its task as a
    stream: what is held of it is its hub and, until a second owner comes, the
    nodes of its first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hubs = np.zeros((3, 0), np.int64), {}  # rows not yet given out; hub and its owner of the key that goes on
        for batch in _with_end(batches):
            if batch is not None:
                held = np.hstack([held, [batch.column(i).to_numpy() for i in range(3)]])
            if not held.shape[1]:
                continue
            held = _one_owner(held)
            key, node, own = held
            cuts = np.append(0, np.flatnonzero(key[1:] != key[:-1]) + 1)
            sizes = np.diff(np.append(cuts, len(key)))
            hub, first = node[cuts], own[cuts]
            opened = (sizes > 1) & ((np.minimum.reduceat(own, cuts) != np.maximum.reduceat(own, cuts)) | (first == SEVERAL))
            if int(key[0]) in hubs:
                hub[0], first[0] = hubs[int(key[0])]
                opened[0] = True
            out, end = np.repeat(opened, sizes), len(key)
            hubs = {}
            if batch is not None:  # the last key may go on: its last node always, the others while one owner has them all
                end = len(key) - 1 if opened[-1] else int(cuts[-1])
                if opened[-1]:
                    hubs = {int(key[-1]): (hub[-1], first[-1])}
            out = np.flatnonzero(out[:end])
            hub, first = np.repeat(hub, sizes)[out], np.repeat(first, sizes)[out]
            apart = (own[out] != first) | (first == SEVERAL)
            again = np.flatnonzero((own[:end] == SEVERAL) & (key[:end] & 3 == 0))
            columns = [pa.array(node[out]), pa.array(key[out]), pa.array(hub), pa.array(own[out]), pa.array(apart)]
            empty = [pa.nulls(len(again), pa.int64())] * 2
            more = [pa.array(node[again]), *empty, pa.array(own[again]), pa.nulls(len(again), pa.bool_())]
            names = ["node", "key", "hub", "own", "apart"]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            yield pa.RecordBatch.from_arrays(more, names=names)
            held = held[:, end:]
        give_back()

    dealt = members.select("key", "node", "own").repartition("key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(run, "node long, key long, hub long, own long, apart boolean")


def _one_owner(rows: np.ndarray) -> np.ndarray:
    """Sorted rows key, node and own with one row for each key and node: own is SEVERAL if it is not the same throughout."""
    key, node, own = rows
    cuts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])))
    least, most = np.minimum.reduceat(own, cuts), np.maximum.reduceat(own, cuts)
    return np.stack([key[cuts], node[cuts], np.where(least == most, least, SEVERAL)])


def link(shared: DataFrame, sets: Callable[[DataFrame], DataFrame], percent: int, signatures: Callable[[DataFrame], DataFrame] | None = None,
         length: int = 0, miss: float = 1e-5) -> DataFrame:
    """The components (node, comp) of all pairs of nodes that share a band and have 100 * common >= percent * union.

    ``shared``: node, key and hub of the keys that several nodes have, own and
    apart (see ``shared_buckets``; nodes of one same document are not linked
    with one another), checkpointed. ``sets`` gives node and set (an array of
    hashes, sorted, without repeats) of the nodes asked for, or of more;
    ``signatures``, if any, node (unique) and sig (``length`` uint16 minima),
    checkpointed: pairs go to ``sets`` after their sequential verification.

    Three steps, each over what the one before left open: a node and the hub it
    shares most bands with; its other hubs; then the members of a bucket of
    different components, exactly, until those that are linked at all are linked.
    """
    plan = least_matches(percent / 100, length, miss) if signatures else None
    sigs = signatures(shared.select("node").distinct()) if signatures else None

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = checkpointed(_verify_signatures(pairs, sigs, plan) if plan else pairs)
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        return checkpointed(jaccard_links(pairs, sets(ends), percent))

    star = shared.where("node <> hub and apart").groupBy("node", "hub").agg(F.count("*").alias("bands"))
    star = checkpointed(star.select(F.col("node").alias("a"), F.col("hub").alias("b"), "bands"))
    best = lambda: star.groupBy("a").agg(F.max_by("b", F.struct("bands", -F.col("b"))).alias("b"))
    links = confirmed(best())
    comps = checkpointed(components(links))
    clean_up(shared.sparkSession)

    def others() -> DataFrame:
        of = lambda c: comps.select(F.col("node").alias(c), F.col("comp").alias(f"of_{c}"))
        both = star.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b"))
        return both.select("a", "b").join(best(), ["a", "b"], "left_anti")

    more = confirmed(others())
    if more.take(1):
        links = links.unionByName(more)
        comps = checkpointed(components(links))
    clean_up(shared.sparkSession)

    def still_open() -> DataFrame:
        """The hub has met the others of its bucket; those have not met one another."""
        labelled = shared.where("node <> hub").join(comps, "node", "left").select("key", "node", "own", F.coalesce("comp", "node").alias("comp"))
        sizes = labelled.groupBy("key", "comp").agg(F.count("*").alias("c"), F.min("own").alias("lo"), F.max("own").alias("hi"))
        several = sizes.groupBy("key").agg(F.sum("c").alias("n"), F.max("c").alias("most"), F.max_by("comp", F.struct("c", "comp")).alias("main"),
                                           F.count("*").alias("comps"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        several = several.where((F.col("comps") > 1) & ((F.col("lo") != F.col("hi")) | (F.col("lo") == SEVERAL))).select("key", "n", "most", "main")
        return labelled.join(several, "key")

    rest = checkpointed(still_open())
    if not rest.take(1):
        return comps
    facts = sets(rest.select("node").distinct())
    facts = facts.join(sigs, "node") if plan else facts
    found = _blocks(rest.join(facts, "node"), BLOCK // 4, _exact(plan, percent))
    return checkpointed(components(links.unionByName(checkpointed(found))))


def sized(df: DataFrame) -> DataFrame:
    """``df`` for a join, broadcast if it has LOOKUP rows at most; it should be checkpointed, as it is counted."""
    return F.broadcast(df) if df.count() <= LOOKUP else df


def _verify_signatures(pairs: DataFrame, sigs: DataFrame, plan: list[tuple[int, int]]) -> DataFrame:
    both = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("s")), "a")
    both = both.join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("t")), "b").select("a", "b", "s", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                at = pa.array(survivors(_signatures(batch.column(2)), _signatures(batch.column(3)), plan))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _blocks(rest: DataFrame, size: int, kernel: Callable[[Members, list[int]], list[tuple[int, int]]]) -> DataFrame:
    """``kernel`` over the members of each bucket, in groups of two blocks (or one), so that each pair that can be a link meets in one group.

    ``most`` of a bucket's ``n`` members are of the component ``main``: they meet the
    others alone, so that a few others are copied to many blocks of it and it is
    not copied. Groups are read one after another from sorted partitions: most are tiny.
    """
    of_main, of_rest = F.ceil(F.col("most") / size), F.ceil((F.col("n") - F.col("most")) / size)
    main, at = F.col("comp") == F.col("main"), F.xxhash64("node")
    mine = F.when(F.col("n") <= size, 0).when(main, of_rest + F.pmod(at, of_main)).otherwise(F.pmod(at, of_rest))
    last = F.when(F.col("n") <= size, 0).when(main, of_rest - 1).otherwise(of_rest + of_main - 1)
    spread = rest.withColumn("mine", mine.cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    spread = spread.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")).drop("other", "n", "most", "main")
    dealt = spread.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _with_end(batches):
            if batch is not None:
                new = pa.Table.from_batches([batch])
                held = new if held is None else pa.concat_tables([held, new]).combine_chunks()
            if held is None or not len(held):
                continue
            names = [held[c].to_numpy() for c in ("key", "i", "j")]
            cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in names], axis=0)) + 1
            ends = [*cuts.tolist(), len(held)] if batch is None else cuts.tolist()
            if ends and (found := kernel(Members(held), ends)):
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])
            held = held.slice(ends[-1] if ends else 0)
        give_back()

    return dealt.mapInArrow(run, "a long, b long")


class Members:
    """Columns of sorted members as numpy arrays, made once for the many small groups in them."""

    def __init__(self, rows: pa.Table):
        self.node, self.comp, self.own, self.mine, i, j = (rows[c].to_numpy() for c in ("node", "comp", "own", "mine", "i", "j"))
        self.two = i != j
        sets = rows["set"].combine_chunks()
        self.sizes, self.starts, self.items = sets.value_lengths().to_numpy(), sets.offsets.to_numpy(), sets.values.to_numpy()
        self.sig = _signatures(rows["sig"].combine_chunks()) if "sig" in rows.column_names else None


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _exact(plan: list[tuple[int, int]] | None, percent: int) -> Callable[[Members, list[int]], list[tuple[int, int]]]:
    """Links that join the components of each group (given by its end) as far as any of its pairs does."""

    def one(m: Members, start: int, end: int, found: list[tuple[int, int]]) -> None:
        comp = m.comp[start:end]
        if end - start < 2 or (comp == comp[0]).all():
            return
        root, own, mine, sizes, starts = comp.copy(), m.own[start:end], m.mine[start:end], m.sizes[start:end], m.starts[start : end + 1]
        held = places = None
        for at in range(end - start - 1):
            open_ = root[at + 1 :] != root[at]
            if own[at] != SEVERAL:
                open_ &= own[at + 1 :] != own[at]
            if m.two[start]:
                open_ &= mine[at + 1 :] != mine[at]
            open_ &= (100 * sizes[at + 1 :] >= percent * sizes[at]) & (100 * sizes[at] >= percent * sizes[at + 1 :])
            close = np.flatnonzero(open_) + at + 1
            if plan and len(close):
                n, matches = plan[0]
                sig = m.sig[start:end]
                close = close[(sig[close, :n] == sig[at, :n]).sum(1) >= matches]
                close = close[survivors(np.broadcast_to(sig[at], (len(close), sig.shape[1])), sig[close], plan)]
                close = close[np.argsort(-(sig[close] == sig[at]).sum(1), kind="stable")]
            if not len(close):
                continue
            if held is None:
                items, places = np.unique(m.items[starts[0] : starts[-1]], return_inverse=True)
                starts, held = starts - starts[0], np.zeros(len(items), bool)
            ours = places[starts[at] : starts[at + 1]]
            held[ours] = True
            for other in close.tolist():
                if root[other] == root[at]:
                    continue
                common = np.count_nonzero(held[places[starts[other] : starts[other + 1]]])
                if 100 * common >= percent * (int(sizes[at]) + int(sizes[other]) - common):
                    root[root == root[other]] = root[at]
                    found.append((int(m.node[start + at]), int(m.node[start + other])))
            held[ours] = False

    def run(members: Members, ends: list[int]) -> list[tuple[int, int]]:
        found: list[tuple[int, int]] = []
        for start, end in zip([0, *ends], ends, strict=False):
            one(members, start, end, found)
        return found

    return run


def jaccard_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets (node, set: an array without repeats) have 100 * common >= percent * union."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("s")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("set").alias("t")), "b")
    common = F.size(F.array_intersect("s", "t"))
    linked = both.withColumn("common", common).where(100 * F.col("common") >= percent * (F.size("s") + F.size("t") - F.col("common")))
    return linked.select("a", "b")


#: Bits of a bitmap of nodes: 8 MB, however many nodes there are.
BITMAP = 26


def bitmap(nodes: DataFrame) -> np.ndarray:
    """A bitmap by the low bits of ``node``: a bounded sieve before an exact join; full of ones it sieves nothing."""
    at = F.col("node").bitwiseAND(F.lit((1 << BITMAP) - 1))
    word, bit = F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, cast((node & {(1 << BITMAP) - 1}) & 63 as int))").alias("bit")
    got = nodes.select(word, bit).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (BITMAP - 6), np.int64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy()
    return out.view(np.uint64)


def sieve(node: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = node.view(np.uint64) & np.uint64((1 << BITMAP) - 1)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
