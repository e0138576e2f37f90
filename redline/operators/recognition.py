"""Recognition quality of pages and the choice between native text and a fallback recogniser."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from redline.functions.text import char_count, without_blanks


def native_reliable(chars: Column, raw_chars: Column, tables: Column, least: int = 16, coverage: float = 0.8) -> Column:
    """A table, or enough characters and enough of the raw text."""
    return (tables > 0) | ((chars >= least) & (F.when(raw_chars > 0, chars / raw_chars).otherwise(0.0) >= coverage))


def fallback_quality(blocks: DataFrame, keys: list[str], repeated: int = 4) -> DataFrame:
    """Characters, tables, the most repeats of a line, reasons and reliable of each page of fallback blocks."""
    lines = blocks.select(*keys, F.explode(F.split(F.coalesce("content", F.lit("")), r"\r\n|[\n\r]")).alias("l")).withColumn("l", without_blanks(F.col("l")))
    most = lines.where("l <> ''").groupBy(*keys, "l").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.max("n").alias("max_repeat"))
    tbl = F.col("tbl")
    width = F.size(tbl["headers"])
    rows = tbl["rows"]
    sparse = F.size(F.filter(rows, lambda r: F.size(F.filter(r, lambda c: F.trim(c) != "")) / width < 0.35))
    facts = blocks.groupBy(*keys).agg(
        F.sum(char_count(F.col("content"))).cast("int").alias("char_count"), F.count_if(tbl.isNotNull()).cast("int").alias("table_count"),
        F.coalesce(F.bool_or(tbl.isNotNull() & (width < 2)), F.lit(False)).alias("narrow"),
        F.coalesce(F.bool_or(tbl.isNotNull() & (width >= 2) & F.exists(rows, lambda r: F.size(r) != width)), F.lit(False)).alias("ragged"),
        F.coalesce(F.bool_or(tbl.isNotNull() & (width >= 2) & (F.size(rows) > 0) & (sparse / F.size(rows) > 0.5)), F.lit(False)).alias("sparse"),
    )
    joined = facts.join(most, keys, "left").withColumn("max_repeat", F.coalesce("max_repeat", F.lit(0)))
    # Reasons.
    rules = [
        (F.col("char_count") < 8, "OCR 返回内容为空或字符过少"), (F.col("max_repeat") >= repeated, "OCR 返回连续或大量重复内容"), (F.col("narrow"), "OCR 表格缺少有效列"),
        (F.col("ragged"), "OCR 表格行列数量不一致"), (F.col("sparse"), "OCR 表格多数数据行字段缺失"),
    ]
    reasons = F.filter(F.array(*[F.when(c, F.lit(t)) for c, t in rules]), lambda r: r.isNotNull())
    return joined.withColumn("reasons", reasons).withColumn("reliable", F.size("reasons") == 0).drop("narrow", "ragged", "sparse")


def route(native_blocks: DataFrame, diagnostics: DataFrame, keys: list[str], fallback: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Native blocks of reliable pages, and what ``fallback`` makes of the others; block ids follow the source.

    ``fallback`` gets the pages (keys) alone and returns blocks like the native ones.
    """
    good = native_blocks.join(diagnostics.where("reliable").select(*keys), keys, "left_semi")
    other = fallback(diagnostics.where("not reliable").select(*keys))
    named = lambda df, source: df.withColumn("block_id", F.concat(F.lit("p"), F.col("page_index"), F.lit(f"-{source}-"), F.col("block_ord")))
    return named(good, "native-text").unionByName(named(other, "fallback"))


def coverage(pages: DataFrame) -> DataFrame:
    return pages.withColumn("coverage", F.when(F.col("raw_chars") > 0, F.col("chars") / F.col("raw_chars")).otherwise(0.0))


def page_counts(diagnostics: DataFrame, keys: list[str]) -> DataFrame:
    n = lambda c: F.count_if(F.expr(c))
    return diagnostics.groupBy(*keys).agg(n("source = 'native'").alias("n_native"), n("source = 'fallback'").alias("n_fallback"), n("not reliable").alias("n_unreliable"))
