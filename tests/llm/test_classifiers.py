import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from redline.llm import langid, quality, toxicity

ODD = [None, "", " ", "123 !?", "\n\n", "\x1c\x85", "x" * 700_000, "İstanbul ß", "日本語"]


def corpus(seed: int, n: int = 240):
    rng = random.Random(seed)
    words = {"aa": ["the", "thing", "and", "other", "wh"], "bb": ["été", "queue", "le", "aux", "ou"]}
    return [(i, " ".join(rng.choices(words[lang], k=30)), lang) for i in range(n) for lang in [rng.choice(["aa", "bb"])]]


def test_language(spark):
    df = spark.createDataFrame(corpus(1), "doc_id long, text string, lang string")
    model = langid.fit(df.where("doc_id % 3 <> 1"))
    got = langid.predict(df.where("doc_id % 3 = 1"), model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark):
    df = spark.createDataFrame(corpus(1), "doc_id long, text string, lang string")
    odd = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").withColumn("LANG_PRED", F.lit("old"))
    got = {r["doc_id"]: r for r in langid.predict(odd, langid.fit(df)).collect()}
    assert len(got) == len(ODD)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in range(6))
    assert all(got[i]["lang_pred"] in ("aa", "bb") for i in (6, 7, 8))
    empty = langid.fit(df.where("false"))
    assert {r["lang_pred"] for r in langid.predict(odd, empty).collect()} == {"und"}
    assert langid.predict(odd.where("false"), langid.fit(df)).count() == 0


def toxic_docs(seed: int, n: int = 600):
    rng = random.Random(seed)
    plain = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        words = rng.choices(plain, k=60)
        y = int(rng.random() < 0.3)
        for _ in range(4 * y):
            words[rng.randrange(60)] = rng.choice(["scum", "idiot", "moron"])
        rows.append((i, " ".join(words), y))
    return rows


def test_toxicity(spark):
    df = spark.createDataFrame(toxic_docs(2), "doc_id long, text string, toxic int")
    docs, labels = df.select("doc_id", "text"), df.select("doc_id", "toxic").where("doc_id % 5 <> 0")
    model = toxicity.fit(docs, labels, label="toxic")
    got = toxicity.score(df.where("doc_id % 5 = 0"), model).collect()
    assert sum((r["score"] >= 0.5) == r["toxic"] for r in got) >= 0.95 * len(got)
    assert 0 < len(model.buckets) < 1 << toxicity.BITS
    again = toxicity.fit(docs.repartition(7), labels, label="toxic")
    assert again.bias == model.bias and list(again.weights) == list(model.weights)


def quality_docs(seed: int, n: int = 400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.6)
        lines = [(" ".join(rng.choices(["some", "plain", "words", "of", "prose"], k=12)) + ".").capitalize() if y else "BUY!! " * 9 for _ in range(rng.randint(1, 6))]
        rows.append((i, "\n".join(lines), y))
    return rows


def test_quality(spark):
    df = spark.createDataFrame(quality_docs(3), "doc_id long, text string, quality int")
    model = quality.fit(df.select("doc_id", "text"), df.select("doc_id", "quality").where("doc_id % 3 <> 1"), label="quality")
    got = quality.score(df.where("doc_id % 3 = 1"), model).collect()
    assert sum((r["score"] >= 0.5) == r["quality"] for r in got) >= 0.97 * len(got)


def test_marginals_by_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    sizes = [1, 4, 3]
    of = np.repeat(np.arange(3), sizes)
    good, tr = rng.normal(size=8), rng.normal(size=(2, 2))
    p, logz, counts = quality.marginals(good, tr, of, 3)
    start = 0
    for c, n in enumerate(sizes):
        paths = list(itertools.product((0, 1), repeat=n))
        w = [np.exp(sum(good[start + i] * y for i, y in enumerate(ys)) + sum(tr[a, b] for a, b in zip(ys, ys[1:]))) for ys in paths]
        assert logz[c] == pytest.approx(np.log(sum(w)))
        for i in range(n):
            assert p[start + i] == pytest.approx(sum(x for x, ys in zip(w, paths) if ys[i]) / sum(w))
        assert counts[c].sum() == pytest.approx(n - 1)
        start += n


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifier_edges(spark, module, label):
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string").withColumn("y", F.lit(3)).withColumn("u", F.lit(1))
    none = spark.createDataFrame([(1, None), (None, 1)], f"doc_id long, {label} int")
    for labels in (none.where("false"), none, spark.createDataFrame([(0, 1), (1, 0), (7, 1), (7, 1), (8, 0)], f"doc_id long, {label} int")):
        got = module.score(odd, module.fit(odd, labels, label=label)).collect()
        assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
        assert got[0]["y"] == 3
    assert module.score(odd.where("false"), module.fit(odd, none, label=label)).count() == 0


def test_language_by_brute_force(spark):
    """Counts and posteriors of the n-grams themselves, in plain loops."""
    rng = random.Random(5)
    names = {"aa": "abcde", "bb": "cdefg", "cc": "xyz"}
    rows = [(i, " ".join("".join(rng.choices(names[lang], k=rng.randint(1, 6))) for _ in range(rng.randint(0, 12))), lang) for i in range(120) for lang in [rng.choice(sorted(names))]]

    def grams(text):
        chars = [c if c.isalpha() else " " for c in text.lower() + " "]
        return [tuple(chars[i : i + n]) for n in langid.ORDERS for i in range(len(chars) - n + 1) if any(c != " " for c in chars[i : i + n])]

    counts, share, buckets = defaultdict(Counter), Counter(r[2] for r in rows), 1 << 15
    for _, text, lang in rows:
        counts[lang].update(grams(text))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.predict(df, langid.fit(df, per_lang=10**6)).collect()}
    for i, text, _ in rows:
        found = grams(text)
        if not found:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0)
            continue
        logs = {x: math.log(share[x] / len(rows)) + sum(math.log((counts[x][g] + 0.05) / (sum(counts[x].values()) + 0.05 * buckets)) for g in found) for x in names}
        best = max(sorted(logs), key=logs.get)
        score = 1 / sum(math.exp(v - logs[best]) for v in logs.values())
        assert got[i]["lang_pred"] == best and abs(got[i]["score"] - score) < 1e-3  # the matrix holds 32-bit floats; buckets hardly collide


def test_ftrl_by_a_plain_loop():
    rng = random.Random(6)
    sets = [sorted(rng.sample(range(40), rng.randint(0, 9))) for _ in range(200)]
    labels = [int(3 in s or 7 in s) for s in sets]
    alpha, beta, l1, l2, positive = 2.0, 1.0, 1.5, 0.1, 3.0
    z, n, bias, bias_n = defaultdict(float), defaultdict(float), 0.0, 0.0

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(4):
        for at, y in zip(sets, labels):
            w = {i: weight(i) for i in at}
            g = (1 / (1 + math.exp(-(sum(w.values()) + bias))) - y) * (positive if y else 1.0)
            for i in at:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
            bias_n += g * g
            bias -= alpha * g / (beta + math.sqrt(bias_n))
    got = toxicity.train([np.array(s, np.int32) for s in sets], labels, alpha, beta, l1, l2, 4, positive)
    want = {i: weight(i) for i in range(40) if weight(i)}
    assert got[0].tolist() == sorted(want) and np.allclose(got[1], [want[i] for i in sorted(want)]) and abs(got[2] - bias) < 1e-9
    assert {3, 7} <= set(want)


def test_scorers_replace_columns_of_any_case_and_repeated_labels_count_once(spark):
    rows = toxic_docs(3, 200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").withColumn("SCORE", F.lit("old")).withColumn("__text", F.lit(1))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, label="toxic")
    twice = toxicity.fit(docs, labels.unionByName(labels.where("doc_id < 50")), label="toxic")
    assert list(model.weights) == list(twice.weights)
    got = toxicity.score(docs, model)
    assert sorted(got.columns) == ["__text", "doc_id", "score", "text"] and got.where("score > 0.5").count() > 0
    lines = quality.score(docs, quality.fit(docs, labels, label="toxic"))
    assert sorted(lines.columns) == ["__text", "doc_id", "score", "text"] and lines.where("score between 0 and 1").count() == 200
