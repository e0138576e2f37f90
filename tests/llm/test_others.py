import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from redline.llm import fingerprint, knn, mixing, urlrules
from redline.llm.queries import RULES, url_rules


# --- mixing -----------------------------------------------------------------------


def water(sizes, weights, share, most):
    total, open_, out = share * sum(sizes), list(range(len(sizes))), [0.0] * len(sizes)
    left = total
    while open_:
        level = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if most * sizes[i] <= weights[i] * level + 1e-9]
        if not full:
            for i in open_:
                out[i] = weights[i] * level
            break
        for i in full:
            out[i] = most * sizes[i]
            left -= out[i]
            open_.remove(i)
    return out


def test_targets(spark):
    rng = random.Random(1)
    for _ in range(4):
        n = rng.randint(1, 9)
        sizes = [rng.choice([0, 5, 100, 10_000, rng.randrange(1, 5000)]) for _ in range(n)]
        names = sorted(f"s{i}" for i in range(n - 1)) + [None]
        df = spark.createDataFrame(list(zip(names, sizes, [1] * n)), "source string, source_size long, n long")
        got = {r["source"]: r["target"] for r in mixing.targets(df, (5, 2, 1), 1.5, 2.0).collect()}
        want = water(sizes, [(5, 2, 1)[i % 3] for i in range(n)], 1.5, 2.0)
        assert [got[x] for x in names] == pytest.approx(want)


def test_flight_keeps_totals():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 50, 999):
        p, size, luck = rng.random(n), rng.integers(0, 500, n).astype(float), rng.random(n)
        out = mixing.flight(p, size, luck)
        assert out.sum() == pytest.approx(p.sum()) and out @ size == pytest.approx(p @ size)
        assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 2
        assert out.min() >= 0 and out.max() <= 1
    same = mixing.flight(np.full(40, 0.3), np.full(40, 7.0), rng.random(40))
    assert same.sum() == pytest.approx(12)


def test_flight_is_unbiased():
    p, size = np.full(6, 0.4), np.array([5.0, 4, 4, 3, 2, 1])
    rng = np.random.default_rng(5)
    mean = np.mean([mixing.flight(p, size, rng.random(6)) for _ in range(6000)], axis=0)
    assert mean == pytest.approx(p, abs=0.03)


def mixed_docs(n=900):
    rng = random.Random(2)
    return [(i, " ".join(["w"] * rng.randint(1, 80)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(n)]


def test_mix(spark, monkeypatch):
    df = spark.createDataFrame(mixed_docs(), "doc_id long, text string, source string")
    first = {r["key"]: r for r in mixing.mix(df).collect()}
    again = {r["key"]: r for r in mixing.mix(df.repartition(5)).collect()}
    assert first == again and len(first) == 900
    monkeypatch.setattr(mixing, "FLIGHT", 40)  # several levels of flights
    for rows in (first.values(), mixing.mix(df).collect()):
        for s in ("a", "b", "c", None):
            own = [r for r in rows if r["source"] == s]
            assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 10
            assert all(0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sum(x["size"] for x in own) for r in own)
    often = mixing.repeat(df.withColumn("key", F.lit(1)), mixing.mix(df)).groupBy("doc_id").count().collect()
    assert sum(r["count"] for r in often) > 900


def test_mix_edges(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, "x y", "a"), (None, "x", None), (2, "", "b"), (3, "x " * 100_000, "a")], "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == 5 and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mix(df.where("false")).count() == 0


# --- top-k -------------------------------------------------------------------------


@pytest.mark.parametrize("seed, n, spread", [(1, 700, 1.0), (2, 300, 0.05)])
def test_top_k_by_brute_force(spark, seed, n, spread):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(12, 8))[rng.integers(0, 12, n)] + spread * rng.normal(size=(n, 8))).astype(np.float32)
    x[: n // 3] = x[0]  # a third of all rows are one vector
    ids = rng.permutation(5 * n)[:n].tolist()
    ids[0] = 10 * n * 100
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")
    z = np.floor(1024 * x.astype(float)).astype(np.int64)
    want = set()
    for i, q in zip(ids, z):
        if i % 100 == 0:
            order = sorted((-int(s), j) for s, j in zip(z @ q, ids) if j != i)[:10]
            want |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(order)}
    got = [tuple(r) for r in knn.top_k(df, F.col("vec_id") % 100 == 0).collect()]
    assert len(got) == len(want) and set(got) == want


def test_top_k_edges(spark):
    rows = [(100, [1.0, 0.0]), (1, [0.5, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [None, 1.0]), (6, [1.0]), (7, []), (None, [1.0, 1.0]), (200, [0.5, 0.0]), (200, [0.5, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = sorted(tuple(r) for r in knn.top_k(df, F.col("vec_id") % 100 == 0).collect())
    assert got == [(100, 1, 1, 524288), (100, 2, 200, 524288), (200, 1, 100, 524288), (200, 2, 1, 262144)]
    assert knn.top_k(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0


# --- url rules ----------------------------------------------------------------------


def judged(url, rules):
    import re

    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    fits = [(len(h + p), len(h), v == "allow", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[4] if best else "allow"


URLS = [
    None, "", "no scheme", "http://", "http://org", "http://org/", "HTTPS://WWW.Example.ORG/es/x?y#z", "http://example.org/en/1", "http://example.org/en/2", "http://a.com/fr/", "http://com/de/1", "http://orgs/x", "http://x.orgs.org/es/",
    "http://a://b/c", "http://example.org:80/es/", "http://u@example.org/es/", "http://exa-mple.org/es/", "http://..org/", "http://org./", "http://example.org?x=/es/", "http://É.org/é", "http://example.org/es/\n", "http://" + "a." * 3000 + "com/de/" + "x" * 9000,
]


def test_url_rules_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(urlrules, "GROUP", 5)
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(1, "")], "page_id long, url string").withColumn("RULE", F.lit("old")).withColumn("salt", F.lit(1))
    for r in urlrules.judge(pages, url_rules(spark)).collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == judged(r["url"], RULES), r["url"]
    assert urlrules.judge(pages.where("false"), url_rules(spark)).count() == 0
    assert {r["verdict"] for r in urlrules.judge(pages, url_rules(spark).where("false")).collect()} == {"allow"}


def test_random_url_rules(spark):
    rng = random.Random(7)
    host = lambda k: ".".join(rng.choice("abc") for _ in range(k))
    path = lambda k: "/" + "".join(rng.choice("xy/") for _ in range(k))
    rules = sorted({(h, p): (rng.choice(["allow", "block"]), h, p) for _ in range(60) for h, p in [(host(rng.randint(1, 3)), rng.choice(["", path(rng.randint(0, 3))]))]}.values())
    urls = [f"http://{host(rng.randint(1, 5))}{path(rng.randint(0, 5))}" for _ in range(500)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = urlrules.judge(pages, spark.createDataFrame(rules, "verdict string, host string, path string")).collect()
    assert len(found) == 500
    for r in found:
        assert (r["host"], r["path"], r["verdict"]) == (lambda j: (j[0], j[1], j[3]))(judged(r["url"], rules))


def test_many_rules_of_a_parent_and_many_hosts(spark):
    """Rules of a parent host are not copied to its subdomains' rules: 5,000 of each stay 10,000, and the longest wins."""
    rules = [("block", "com", f"/p{i}/") for i in range(5000)] + [("allow", f"h{i}.com", "/p7/x") for i in range(5000)]
    frame = spark.createDataFrame(rules, "verdict string, host string, path string")
    own = urlrules.own_rules(frame)
    assert own.count() == 10_000 and urlrules.chains(own).agg(F.max(F.size("chain"))).first()[0] == 2
    urls = [(i, f"http://h{i}.com/p7/{'x' if i % 2 else 'y'}z") for i in range(0, 5000, 50)] + [(9000, "http://other.com/p4999/"), (9001, "http://other.com/q/")]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlrules.judge(spark.createDataFrame(urls, "page_id long, url string"), frame).collect()}
    assert all(got[i] == ((f"h{i}.com/p7/x", "allow") if i % 2 else ("com/p7/", "block")) for i in range(0, 5000, 50))
    assert got[9000] == ("com/p4999/", "block") and got[9001] == (None, "allow")


def test_no_python_in_the_plan(spark):
    pages = spark.createDataFrame([(1, "http://org/")], "page_id long, url string")
    plan = urlrules.judge(pages, url_rules(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


# --- fingerprints --------------------------------------------------------------------


def test_gear_hash_and_chunks():
    rng = random.Random(9)
    data = bytes(rng.randrange(256) for _ in range(4000))
    h = fingerprint.gear(data)
    for i in (0, 5, 15, 16, 700):
        want = 0
        for j in range(min(16, i + 1)):
            want = (want + (int(fingerprint._gear[data[i - j]]) << j)) & 0xFFFF
        assert int(h[i]) == want
    parts = fingerprint.chunks(data)
    assert b"".join(parts) == data and all(fingerprint.LEAST <= len(c) <= fingerprint.MOST for c in parts[:-1])
    assert fingerprint.chunks(b"") == [] and fingerprint.chunks(b"abc") == [b"abc"]


def test_insertion_keeps_most_chunks():
    rng = random.Random(10)
    text = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(400))
    a, b = fingerprint.fingerprint(text), fingerprint.fingerprint(text[:900] + "inserted " + text[900:])
    assert fingerprint.likeness(a, b) > 0.9 and fingerprint.likeness(a, a) == 1
    assert fingerprint.read(fingerprint.written(a)) == a
    assert fingerprint.likeness(a, fingerprint.fingerprint(text[::-1])) < 0.05
    assert fingerprint.likeness({}, {}) == 1 and fingerprint.likeness(a, {}) == 0


@pytest.mark.parametrize("block", [2 << 20, 300])
def test_compare_with_next(spark, monkeypatch, block):
    monkeypatch.setattr(fingerprint, "BLOCK", block)
    rng = random.Random(11)
    texts = {i * 3: "".join(rng.choices("abc é\n", k=rng.choice([0, 1, 2, 7, 200]))) for i in range(40)}
    texts[9] = None
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("t", F.lit(1)).withColumn("block", F.lit(2))
    got = {r["doc_id"]: r for r in fingerprint.compare_with_next(df).collect()}
    keys = sorted(texts, reverse=True)
    assert sorted(got) == sorted(texts)
    for n, k in enumerate(keys):
        t, u = texts[k] or "", texts[keys[(n + 1) % len(keys)]] or ""
        m = len(t) // 3
        want = t[: len(t) - m] + u[:m]
        r = got[k]
        assert (r["n_chars"], r["edited_text"], r["fingerprint"]) == (len(t), want, fingerprint.written(fingerprint.fingerprint(t)))
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert hashlib.sha256(r["edited_text"].encode()).hexdigest() == hashlib.sha256(want.encode()).hexdigest()


def test_fingerprint_edges(spark):
    one = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    assert fingerprint.compare_with_next(one).first()["edited_text"] == "abcdab"
    assert fingerprint.compare_with_next(one.where("false")).count() == 0
    ties = spark.createDataFrame([(1, "b"), (1, "a"), (None, "c"), (2, "d")], "doc_id long, text string")
    assert fingerprint.compare_with_next(ties).count() == 4
