"""Corpus pipeline: toxicity, near-duplicates, repeated passages, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next one's ``docs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from redline.llm import bpe, mixing, neardup, passages, queries, toxicity
from redline.llm.common import checkpoint_dir, free_names, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under 0.5, by a model of all labelled documents.

    Null and empty texts have the toxicity of the bias alone, repeated rows the
    same each; all columns stay as they are.
    """
    known = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(known, queries.labels_of(spark, sf_dir), label="toxic")
    out = free_names(docs, "__toxicity")[0]
    return toxicity.score(docs, model, out=out).where(F.col(out) < 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that 5-word shingles link at 0.8.

    Rows of one doc_id count as one document and stay or go together; a null
    doc_id stays if no other of its group has one. Documents without words are
    linked with nothing and stay.
    """
    name = free_names(docs, "__id")[0]
    kept = neardup.near_duplicates(docs.select("doc_id", "text")).where("kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages that a document of a smaller doc_id keeps.

    Every document stays, with an empty text if all of it was a repeat; null
    texts and documents without a doc_id stay as they are.
    """
    return passages.cleaned(docs, passages.repeats(docs.select("doc_id", "text")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them; a null source is a source, a null text has no words."""
    return mixing.repeat(docs, mixing.mix(docs.select("doc_id", "source", "text")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and ids of every document; a null text has no ids."""
    coded = bpe.encode(docs.select("doc_id", "source", "text"), queries.public_vocabulary())
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("passages", drop_repeated_passages),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: No stage of it can be said in SQL: tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written in the shared folder and read again; a stage's rows go once the next one is written."""
    docs, folder, before = table(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{before}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = name
    return docs.select("doc_id", "source", "n_tokens", F.concat_ws(",", F.col("ids").cast("array<string>")).alias("ids"))
