"""Each stage of the corpus pipeline against a brute-force version, on the rows that the stage before it kept."""

import os
import random
import sys

import pytest
from pyspark.sql import functions as F

from test_near import brute  # the same definition of a link

pytest.importorskip("public_tokenizers")
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    vocab = [f"v{i}" for i in range(3000)]
    sentence = lambda: " ".join(rng.choices(vocab, k=rng.randint(5, 12))).capitalize() + "."
    passage = " ".join(sentence() for _ in range(10))
    docs, labels = [], []
    for i in range(400):
        text = " ".join(sentence() for _ in range(12))
        toxic = i % 5 == 0
        if toxic:
            words = text.split()
            for _ in range(6):
                words[rng.randrange(len(words))] = rng.choice(["scum", "idiot"])
            text = " ".join(words)
        if i in (21, 31):
            text = text + " " + passage + " " + sentence()
        docs.append((i, text, "en", f"s{i % 4}", len(text)))
        if i % 3:
            labels.append((i, 1, int(toxic)))
    docs += [(1000 + i, docs[i][1], "en", "s1", docs[i][4]) for i in (11, 12, 13)]
    docs += [(2000, docs[14][1].replace(docs[14][1].split()[40], "changed", 1), "en", None, 5), (2001, None, None, "s9", None), (2002, "", "en", "s9", 0)]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, passage


def test_stages(spark, tables):
    sys.path.insert(0, ROOT)
    import corpus_pipeline as pipeline

    d, passage = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = pipeline.drop_toxic(spark, docs, d)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert all(i in ids for i in range(400) if i % 5) and not any(i in ids for i in range(0, 400, 5)) and {2001, 2002} <= ids

    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    want, _ = brute(rows, 5)
    near = pipeline.drop_near_duplicates(spark, kept, d)
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(k for (k, _), v in want.items() if k == v)
    assert not {1011, 1012, 1013, 2000} & {r["doc_id"] for r in near.collect()}

    cut = pipeline.drop_repeated_passages(spark, near, d)
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert passage in texts[21] and passage not in texts[31] and len(texts) == near.count()
    before = {r["doc_id"]: r["text"] for r in near.collect()}
    assert all(texts[i] == before[i] for i in texts if i != 31)

    mixed = pipeline.mix_sources(spark, cut, d)
    sizes = cut.groupBy("source").agg(F.sum(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))).alias("n"))
    assert mixed.columns == docs.columns and mixed.count() > cut.count() and sizes.count() >= 4

    coded = pipeline.encode(spark, mixed, d)
    assert coded.count() == mixed.count() and coded.where("n_tokens <> size(ids)").count() == 0
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "passages", "mixing", "byte_bpe"]


def test_run(spark, tables):
    sys.path.insert(0, ROOT)
    import corpus_pipeline as pipeline

    first, again = (sorted(map(tuple, pipeline.run(spark, tables[0]).collect()), key=str) for _ in range(2))
    assert first == again and first


def test_stages_with_clashing_names_and_empty_tables(spark, tables):
    """Columns named as the stages' own helpers are, rows without key, text or source, and no rows at all."""
    sys.path.insert(0, ROOT)
    import corpus_pipeline as pipeline

    d, _ = tables
    docs = spark.read.parquet(f"{d}/documents.parquet").where("doc_id > 300")
    docs = docs.unionByName(docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c d e f").alias("text"), "lang", F.lit(None).cast("string").alias("source"), "n_chars"))
    extra = ["__id", "__toxicity", "__text", "__doc", "__spans", "__key", "__copies", "node", "key", "score", "start"]
    for c in extra:
        docs = docs.withColumn(c, F.lit(1))
    for name, stage in pipeline.STAGES[:-1]:
        got = stage(spark, docs, d)
        assert got.columns == docs.columns and got.count() > 0, name
        assert got.where(" or ".join(f"{c} <> 1" for c in extra)).count() == 0, name
        assert stage(spark, docs.where("false"), d).count() == 0, name
    assert pipeline.encode(spark, docs, d).count() == docs.count() and pipeline.encode(spark, docs.where("false"), d).count() == 0
