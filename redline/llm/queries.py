"""The operators bound to the driver's tables: one query opN_<name> for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from redline.llm import bpe, fingerprint, knn, langid, mixing, neardup, passages, quality, toxicity, urlrules
from redline.llm.common import crc_fold, table

#: The rules of op5: verdict, host, path prefix.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def public_vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> bpe.Vocabulary:
    import public_tokenizers

    return bpe.Vocabulary.read(public_tokenizers.path(name), public_tokenizers.PATTERN)


def labels_of(spark: SparkSession, sf_dir: str, held_out: Column | None = None) -> DataFrame:
    """The labels of documents that are not held out."""
    labels = table(spark, sf_dir, "labels")
    return labels if held_out is None else labels.where(~held_out)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("key").alias("doc_id"), "source", "size", "source_size", "target", "copies", "taken")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_fold("doc_id", 3) == 1
    model = langid.fit(docs.where(~held_out).select("doc_id", "text", "lang"))
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    return langid.predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return knn.top_k(vectors, F.col("vec_id") % 100 == 0)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_fold("doc_id", 3) == 1
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(texts, labels_of(spark, sf_dir, held_out), label="quality")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def url_rules(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS rules(verdict, host, path)")


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlrules.judge(pages, url_rules(spark)).select("page_id", "host", "path", "rule", "verdict")


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages to remove, with the document that keeps each."""
    return passages.repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_decode(docs, public_vocabulary()).drop("text")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_fold("doc_id", 5) == 0
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(texts, labels_of(spark, sf_dir, held_out), label="toxic")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprint.compare_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256")
    return made.select("doc_id", "n_chars", digest, "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=2)


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_language": op2_language,
    "op3_top_k": op3_top_k,
    "op4_quality": op4_quality,
    "op5_url_rules": op5_url_rules,
    "op6_passages": op6_passages,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_toxicity": op8_toxicity,
    "op9_fingerprints": op9_fingerprints,
    "op10_near_duplicates": op10_near_duplicates,
}

_PARTS = r"regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', {})"
_FITS = " UNION ALL ".join(f"SELECT '{v}' AS verdict, '{h}' AS host, '{p}' AS path" for v, h, p in RULES)

ORACLES = {
    "op5_url_rules": f"""
WITH rules AS ({_FITS}),
parts AS (
  SELECT page_id, url, translate({_PARTS.format(1)}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         {_PARTS.format(2)} AS path
  FROM pages
),
best AS (
  SELECT p.page_id, p.url, arg_max(struct_pack(rule := r.host || r.path, verdict := r.verdict), length(r.host || r.path)) AS b
  FROM parts p JOIN rules r
    ON (p.host = r.host OR p.host LIKE '%.' || r.host) AND starts_with(p.path, r.path)
  GROUP BY p.page_id, p.url
)
SELECT p.page_id, p.host, p.path, b.b.rule AS rule, coalesce(b.b.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN best b ON p.page_id IS NOT DISTINCT FROM b.page_id AND p.url IS NOT DISTINCT FROM b.url
""",
    "op3_top_k": """
WITH ints AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM ints q JOIN ints c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
""",
}
