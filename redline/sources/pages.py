"""Pages of a text layer: lines and tables with boxes, as a PDF reader or a JSON export gives them, to blocks and diagnostics.

A page is one row: the keys, raw_text, lines (array of block, text, box) and
tables (array of box and rows). No PDF library is needed here: whatever reads
the file hands over these rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from redline.functions import text as T
from redline.functions.kernels import nfkc
from redline.operators import layout as L, recognition as Q, tables as B

PAGE = (
    "doc_id long, page_index int, raw_text string, lines array<struct<block: int, text: string, box: array<double>>>, "
    "tables array<struct<box: array<double>, rows: array<array<string>>>>"
)
# Reasons of an unreliable page.
FEW_CHARS, LOW_COVERAGE = "PDF 页面文本层为空或字符过少", "PDF 文本层恢复完整度不足"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages from JSON lines."""
    return spark.read.schema(PAGE).json(path)


def cell_text(c: Column) -> Column:
    """A normalised cell: lines joined with nothing between, other blank runs as one space; null gives ''."""
    joined = F.array_join(F.transform(F.split(c, r"\r\n|[\n\r\x0B\x0C\u0085\u2028\u2029]"), T.strip), "")
    return T.strip(F.regexp_replace(joined, "[ \\t\u3000]+", " "))


def native_tables(pages: DataFrame, keys: list[str], unicode: bool = True) -> DataFrame:
    """keys, table_ord, box, tbl of the tables with two columns or more: cells normalised, rows made canonical."""
    cells = pages.select(*keys, F.posexplode("tables").alias("table_ord", "t"))
    cells = cells.where(F.coalesce(F.array_max(F.transform("t.rows", lambda r: F.size(r))), F.lit(0)) >= 2)
    rows = cells.select(*keys, "table_ord", F.col("t.box").alias("box"), F.posexplode(F.filter("t.rows", lambda r: r.isNotNull())).alias("row_ord", "row"))
    one = rows.select(*keys, "table_ord", "box", "row_ord", F.posexplode(F.when(F.size("row") > 0, F.col("row")).otherwise(F.array(F.lit("")))).alias("col_ord", "cell"))
    text = nfkc(F.coalesce("cell", F.lit(""))) if unicode else F.coalesce("cell", F.lit(""))
    one = one.withColumn("cell", text).withColumn("cell", cell_text(F.col("cell")))
    ordered = lambda n, c: F.transform(F.array_sort(F.collect_list(F.struct(n, c))), lambda x: x[c])
    by_row = one.groupBy(*keys, "table_ord", "box", "row_ord").agg(ordered("col_ord", "cell").alias("cells"))
    whole = by_row.groupBy(*keys, "table_ord", "box").agg(ordered("row_ord", "cells").alias("rows"))
    made = whole.withColumn("rows", B.canonical_rows(F.col("rows")))
    return made.select(*keys, "table_ord", "box", F.struct(F.get("rows", F.lit(0)).alias("headers"), F.slice("rows", 2, F.size("rows")).alias("rows")).alias("tbl"))


def native_lines(pages: DataFrame, tables: DataFrame, keys: list[str], tolerance: float = 3.0) -> DataFrame:
    """keys, line_ord, text, box of what stands outside the tables: visual rows of each block, in reading order, continuations merged."""
    parts = pages.select(*keys, F.posexplode("lines").alias("frag_ord", "l")).select(*keys, "frag_ord", F.col("l.block").alias("block"), T.strip(F.col("l.text")).alias("text"), F.col("l.box").alias("box"))
    parts = L.outside_tables(parts.where((F.size("box") >= 4) & (F.col("text") != "")), tables.select(*keys, "box"), keys)
    rows = L.join_rows(L.visual_rows(parts, [*keys, "block"], tolerance), [*keys, "block"])
    ordered = L.reading_order(rows, keys).withColumnRenamed("read_ord", "line_ord")
    return L.merge_continuations(ordered.select(*keys, "line_ord", "text", "box"), keys)


def native_blocks(pages: DataFrame, keys: list[str], unicode: bool = True) -> DataFrame:
    """Blocks of each page in reading order: keys, block_ord, block_id, label, bbox, content, tbl. The last key is the page's index."""
    tables = native_tables(pages, keys, unicode)
    lines = native_lines(pages, tables, keys)
    page = F.col(keys[-1])
    name = lambda kind, n: F.concat(F.lit("p"), page, F.lit(f"-native-{kind}-"), n)
    order = Window.partitionBy(*keys).orderBy("line_ord")
    text = lines.where("text <> ''").withColumn("n", F.row_number().over(order) - 1)
    text = text.select(*keys, name("text", F.col("n")).alias("block_id"), F.lit("text").alias("label"), F.col("box").alias("bbox"), F.col("text").alias("content"), B.none_table().alias("tbl"))
    content = F.array_join(F.transform(F.concat(F.array("tbl.headers"), F.col("tbl.rows")), lambda r: F.array_join(r, " | ")), "\n")
    found = tables.select(*keys, name("table", F.col("table_ord")).alias("block_id"), F.lit("table").alias("label"), F.col("box").alias("bbox"), content.alias("content"), "tbl")
    both = text.unionByName(found).withColumnRenamed("bbox", "box")
    placed = L.reading_order(both, keys).withColumnRenamed("read_ord", "block_ord").withColumnRenamed("box", "bbox")
    return placed.select(*keys, "block_ord", "block_id", "label", "bbox", "content", "tbl")


def native_diagnostics(pages: DataFrame, blocks: DataFrame, keys: list[str], least: int = 16, coverage: float = 0.8) -> DataFrame:
    """keys, source, reliable, reasons, char_count and table_count of each page."""
    got = blocks.groupBy(*keys).agg(F.sum(T.char_count(F.col("content"))).cast("int").alias("char_count"), F.count_if(F.col("tbl").isNotNull()).cast("int").alias("table_count"))
    joined = pages.select(*keys, T.char_count(F.col("raw_text")).alias("raw_chars")).join(got, keys, "left").fillna(0, ["char_count", "table_count"])
    joined = Q.coverage(joined.withColumnRenamed("char_count", "chars"))
    good = (F.col("table_count") > 0) | ((F.col("raw_chars") >= least) & (F.col("coverage") >= coverage))
    reason = F.when(F.col("raw_chars") < least, FEW_CHARS).otherwise(LOW_COVERAGE)
    return joined.select(*keys, F.lit("native").alias("source"), good.alias("reliable"), F.when(good, F.array().cast("array<string>")).otherwise(F.array(reason)).alias("reasons"),
                         F.col("chars").alias("char_count"), "table_count")
