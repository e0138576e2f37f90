import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from redline.llm import near, neardup, passages


def shingles(text, width):
    ws = (text or "").encode().lower().split()
    if not ws:
        return set()
    return {tuple(ws[i : i + width]) for i in range(len(ws) - width + 1)} or {tuple(ws)}


def brute(rows, width, percent=80):
    sets = [shingles(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[top(i)].append(rows[i][0])
    return {(rows[i][0], rows[i][1]): min(groups[top(i)]) for i in range(len(rows))}, sets


def near_rows(seed, n=150):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [rng.choices(vocab, k=rng.choice([1, 2, 3, 12, 40, 90])) for _ in range(30)]
    rows = []
    for i in range(n):
        ws = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            ws[rng.randrange(len(ws))] = rng.choice(vocab)
        rows.append((i * 7, " ".join(ws)))
    return rows


@pytest.mark.parametrize("seed, width", [(1, 2), (2, 2), (3, 5)])
def test_near_duplicates_by_brute_force(spark, seed, width):
    rows = near_rows(seed)
    want, sets = brute(rows, width)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=width).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        assert r["component_id"] == want[r["doc_id"], texts[r["doc_id"]]]
        assert r["n_shingles"] == len(shingles(texts[r["doc_id"]], width))
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_chain_in_one_bucket(spark, monkeypatch):
    """A long chain of near copies, each linked with its neighbours alone, in blocks of a few members."""
    monkeypatch.setattr(near, "BLOCK", 16)
    ws = [f"x{i}" for i in range(120)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(ws)))
        ws[(i * 2) % 120] = f"y{i}"
    want, _ = brute(rows, 2)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {k: v for (k, _), v in want.items()}


def test_near_duplicate_edges(spark):
    rows = [(5, None), (4, ""), (3, " \t\n"), (2, "one"), (1, "ONE"), (9, "a b c"), (9, "a b c"), (None, "a b c"), (8, "é É"), (7, "z " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("KEY", F.lit("x"))
    got = defaultdict(list)
    for r in neardup.near_duplicates(df, width=2).collect():
        got[r["doc_id"]].append((r["n_shingles"], r["component_id"], r["kept"]))
    assert got[5] == [(0, 5, True)] and got[4] == [(0, 4, True)] and got[3] == [(0, 3, True)]
    assert got[2] == [(1, 1, False)] and got[1] == [(1, 1, True)]
    assert got[9] == [(2, 9, True)] * 2 and got[None] == [(2, 9, False)]
    assert neardup.near_duplicates(df.where("false")).count() == 0


def test_components_both_ways(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i + 1000, i + 1001) for i in range(40)]
    up = {x: x for p in pairs for x in p}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        p, q = top(a), top(b)
        up[max(p, q)] = min(p, q)
    links = spark.createDataFrame(pairs, "a long, b long")
    for few in (1000, 0):
        got = {r["node"]: r["comp"] for r in near.components(links, few).collect()}
        assert all(top(x) == got.get(x, x) for x in up)
    assert near.components(links.where("false"), 0).count() == 0 and near.components(links.where("false")).count() == 0


def test_bayes_plan_keeps_similar_pairs():
    plan = near.least_matches(0.8, 192, 1e-5)
    rng = np.random.default_rng(2)
    a = np.zeros((4000, 192), np.uint16)
    close, far = (rng.random(a.shape) > s for s in (0.8, 0.4))
    assert len(near.survivors(a, close.astype(np.uint16), plan)) >= 3995
    assert len(near.survivors(a, far.astype(np.uint16), plan)) == 0


@pytest.mark.parametrize("rows_a_batch", [1, 3, 10_000])
def test_shared_buckets_as_a_stream(spark, rows_a_batch):
    """Hubs, owners and repeated nodes of buckets that run over many batches, and of some that are one document's alone."""
    rng = random.Random(rows_a_batch)
    rows = [(4 * rng.randrange(12) + rng.randrange(3), rng.choice([-9, -2, *range(8)]), rng.choice([near.SEVERAL, 0, 1, 1, 1, 2])) for _ in range(150)]
    rows += [(400, n, 5) for n in range(9)] + [(404, n, 5) for n in range(4)] + [(404, 30, 6), (408, 1, near.SEVERAL), (412, 1, 7)]
    owners = defaultdict(set)
    for key, node, own in rows:
        owners[key, node].add(own)
    one = {k: next(iter(v)) if len(v) == 1 else near.SEVERAL for k, v in owners.items()}
    want, again = set(), set()
    for key in {k for k, _ in one}:
        nodes = sorted(n for k, n in one if k == key)
        own = {n: one[key, n] for n in nodes}
        hub = nodes[0]
        if len(nodes) > 1 and (len(set(own.values())) > 1 or own[hub] == near.SEVERAL):
            want |= {(n, key, hub, own[n], own[n] != own[hub] or own[hub] == near.SEVERAL) for n in nodes}
        again |= {(n, own[n]) for n in nodes if key % 4 == 0 and own[n] == near.SEVERAL}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows_a_batch))
    try:
        got = near.shared_buckets(spark.createDataFrame(rows, "key long, node long, own long")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    found = [tuple(r) for r in got if r["key"] is not None]
    assert set(found) == want and len(found) == len(want)
    assert {(r["node"], r["own"]) for r in got if r["key"] is None} == again


def test_blocks_of_a_large_component(spark):
    """Each pair of different components meets, whatever the sizes; the largest component isn't copied by the number of its own blocks."""
    rng = random.Random(9)
    rows = []
    for key, (large, others) in enumerate([(60, 3), (2, 2), (20, 30), (1, 40)]):
        members = [(0, i) for i in range(large)] + [(1 + i % 7, large + i) for i in range(others)]
        most = max(sum(c == k for c, _ in members) for k in range(8))
        main = max(range(8), key=lambda k: sum(c == k for c, _ in members))
        rows += [(key, 1000 * key + n, 1000 * key + c, len(members), most, 1000 * key + main) for c, n in members]
    rest = spark.createDataFrame(rows, "key long, node long, comp long, n long, most long, main long").withColumn("own", F.lit(near.SEVERAL)).withColumn("set", F.array("node"))
    met, copies = set(), defaultdict(int)

    def kernel(m, ends):
        out = []
        for start, end in zip([0, *ends], ends):
            for x in range(start, end):
                out.append((int(m.node[x]), int(m.node[x])))
                out += [(int(m.node[x]), int(m.node[y])) for y in range(x + 1, end) if not m.two[start] or m.mine[x] != m.mine[y]]
        return out

    for r in near._blocks(rest, 8, kernel).collect():
        if r["a"] == r["b"]:
            copies[r["a"]] += 1
        else:
            met.add((min(r["a"], r["b"]), max(r["a"], r["b"])))
    for key in range(4):
        mine = [(node, comp) for k, node, comp, *_ in rows if k == key]
        assert all((min(a, b), max(a, b)) in met for i, (a, p) in enumerate(mine) for b, q in mine[:i] if p != q)
    assert all(copies[n] == 1 for n in range(60))  # three others: one block, which each block of the sixty meets


def prose(rng, sentences, tag):
    return " ".join(" ".join(f"{tag}{rng.randrange(10**6)}" for _ in range(rng.randint(4, 14))).capitalize() + "." for _ in range(sentences))


def test_planted_passages(spark):
    rng = random.Random(6)
    rows, planted = [], {}
    for p in range(12):
        passage = prose(rng, 9, f"p{p}q")
        assert len(passage.split()) > 50
        planted[p] = passage
        for c in range(3):
            before, after = prose(rng, 5, f"b{p}{c}z"), prose(rng, 5, f"c{p}{c}z")
            rows.append((p * 10 + c, before.rsplit(" ", 2)[0] + " " + passage + " " + after))
    rows += [(500 + i, prose(rng, 8, f"clean{i}z")) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = passages.repeats(df)
    found = spans.collect()
    assert {r["doc_id"] for r in found} == {p * 10 + c for p in planted for c in (1, 2)}
    assert all(r["keeper"] == r["doc_id"] // 10 * 10 for r in found)
    cleaned = {r["doc_id"]: r["text"] for r in passages.cleaned(df, spans).collect()}
    for doc, text in rows:
        if doc >= 500 or doc % 10 == 0:
            assert cleaned[doc] == text
        else:
            kept = set(planted[doc // 10].split()) & set(cleaned[doc].split())
            # at most a sentence (14 words here) at each end stays: see the module's docstring
            assert len(kept) <= 28 and planted[doc // 10] not in cleaned[doc] and all(w in text for w in cleaned[doc].split())


def test_near_equal_paragraphs_cluster(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(90)]
    other = list(base)
    other[88] = "changed"
    rows = [(1, "Start " + " ".join(base) + "."), (2, "Start " + " ".join(other) + ".")]
    assert [r["doc_id"] for r in passages.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()] in ([2], [])


def test_near_equal_paragraphs_by_seeded_pairs(spark):
    """Pairs of single paragraphs that one changed word takes to a similarity from 0.8 to 0.9: nearly all are linked, and no others."""
    rng, rows, close = random.Random(31), [], 0
    for p in range(300):
        words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        other = list(words)
        for at in (rng.sample(range(10, 50), 1) if p % 3 else range(8, 50, 8)):
            other[at] = f"v{rng.randrange(10**6)}"
        a, b = shingles(" ".join(words), 5), shingles(" ".join(other), 5)
        assert (0.8 <= len(a & b) / len(a | b) < 0.9) == bool(p % 3)
        close += bool(p % 3)
        rows += [(2 * p, " ".join(words) + "."), (2 * p + 1, " ".join(other) + ".")]
    found = {r["doc_id"]: r["keeper"] for r in passages.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(d % 2 and k == d - 1 and d // 2 % 3 for d, k in found.items())
    assert len(found) >= 0.94 * close


def test_changed_word_near_the_end_is_found(spark):
    """The pair of test_near_equal_paragraphs_cluster, on many seeds: [2] each time."""
    rng, rows = random.Random(32), []
    for p in range(100):
        base = [f"w{rng.randrange(10**6)}" for _ in range(90)]
        other = list(base)
        other[88] = "changed"
        rows += [(2 * p, "Start " + " ".join(base) + "."), (2 * p + 1, "Start " + " ".join(other) + ".")]
    found = passages.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(1, 200, 2))


def test_passages_from_within_sentences(spark):
    """Passages of 51 to 60 words that start and end within sentences of 15 to 40, among different words: each is found."""
    rng, rows, planted = random.Random(33), [], {}
    for p in range(100):
        words = " ".join(" ".join(f"p{p}q{rng.randrange(10**6)}" for _ in range(rng.randint(15, 40))) + "." for _ in range(9)).split()
        at = next(i for i in range(20, 60) if not words[i - 1].endswith("."))
        end = next(j for j in range(at + 51 + p % 8, at + 61) if not words[j - 1].endswith("."))
        planted[p] = words[at:end]
        assert 51 <= end - at <= 60
        for c in range(2):
            before, after = prose(rng, 5, f"b{p}{c}z"), prose(rng, 5, f"c{p}{c}z")
            rows.append((2 * p + c, before.rstrip(".") + " " + " ".join(planted[p]) + " " + after))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = passages.repeats(df)
    assert {(r["doc_id"], r["keeper"]) for r in spans.collect()} == {(2 * p + 1, 2 * p) for p in planted}
    for r in passages.cleaned(df, spans).where("doc_id % 2 = 1").collect():
        left = set(r["text"].split()) & set(planted[r["doc_id"] // 2])
        assert len(left) <= len(planted[r["doc_id"] // 2]) - passages.LEAST


def test_passages_of_short_sentences(spark):
    """Lists, words with '!' and a line per word have no sentence that starts a paragraph: their repeats are found all the same."""
    rng, rows = random.Random(35), []
    shapes = [lambda w: w + "!", lambda w: w + "\n", lambda w: f"{w} {w[::-1]} x.\n"]
    for p in range(60):
        line = lambda tag: shapes[p % 3](f"{tag}{rng.randrange(10**6)}")  # noqa: B023, E731
        passage = " ".join(line(f"p{p}q") for _ in range(55))
        for c in range(2):
            rows.append((2 * p + c, " ".join([line(f"b{p}{c}z"), line(f"b{p}{c}z"), passage, line(f"c{p}{c}z")])))
    rows += [(900, "a b! " * 40), (901, "c d! " * 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = passages.repeats(df).collect()
    assert {(r["doc_id"], r["keeper"]) for r in found} == {(2 * p + 1, 2 * p) for p in range(60)}
    assert len(found) == 60
    texts = [t for d, t in rows if d != 901]
    assert set(passages.paragraphs(texts)[0].tolist()) == set(range(len(texts)))


def test_any_48_words_hold_a_paragraph():
    rng = random.Random(34)
    vocab = [f"v{i}" for i in range(40)]
    for n in (48, 49, 70, 300):
        for common in (rng.choices(vocab, k=n), ["same"] * n, ["a", "b", "c"] * (n // 3)):
            nodes = []
            for c in range(2):
                around = [rng.choices([f"x{c}{i}" for i in range(90)], k=rng.randrange(40)) for _ in range(2)]
                text = " ".join(around[0] + common[:48] + around[1]) if n < 50 else " ".join(around[0] + common + around[1])
                nodes.append(set(passages.paragraphs(["other text", "", text])[3].tolist()))
            assert nodes[0] & nodes[1]


def test_passage_edges(spark):
    rows = [(1, None), (2, ""), (3, "short."), (4, "w " * 200_000), (5, "Le " * 300), (None, "Le " * 300), (6, "\n" * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(1)).withColumn("__spans", F.lit(2))
    spans = passages.repeats(df)
    assert spans.count() == 0
    got = passages.cleaned(df.drop("__spans"), spans)
    assert got.count() == len(rows) and got.columns == ["doc_id", "text", "start"]
    assert passages.repeats(df.where("false")).count() == 0
