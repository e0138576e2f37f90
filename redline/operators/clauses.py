"""Clause segmentation as window functions.

Items of a document side are cut into lines; a line starts a clause or goes on
with the one before. Clause ids are a running count of starts, texts an ordered
concatenation, so a corpus of documents is segmented in one shuffle by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from redline.functions import text as T
from redline.functions.geometry import line_box

# Layout labels and the kinds of item they stand for.
LABEL_KINDS = {"doc_title": "title", "title": "title", "paragraph_title": "heading", "heading": "heading", "table": "table"}


def item_kind(label: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LABEL_KINDS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, label), F.lit("paragraph"))


def blocks_to_items(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Pages flattened in reading order: an ordinal over all blocks of a document."""
    order = Window.partitionBy(*keys).orderBy("page_index", "block_ord")
    return blocks.select(
        *keys, (F.row_number().over(order) - 1).alias("item_ord"), item_kind(F.col("label")).alias("kind"), F.lit(0).alias("heading_level"),
        "page_index", "bbox", F.col("content").alias("text"), "tbl",
    )


def signature_cells(table: Column, unicode: bool = True) -> Column:
    """The non-blank cells of a signature table, null for any other table: each starts with a field, two at least."""
    cells = F.flatten(F.concat(F.array(table["headers"]), table["rows"]))
    filled = F.filter(F.transform(cells, lambda c: T.strip(F.regexp_replace(c, r"(?U)\s+", " "))), lambda c: c != "")
    is_field = lambda c: c.rlike(T.ROLE_FIELD) | c.rlike(T.PLAIN_FIELD)
    return F.when((F.size(filled) >= 2) & F.forall(filled, is_field), filled)


def segment(items: DataFrame, keys: list[str], unicode: bool = True) -> DataFrame:
    """Clauses (keys, clause_ord from 1, level, number, title, text, field_key, boxes and, where items have tbl, tables) of items.

    ``items``: keys, item_ord, kind, heading_level, text and, optionally, bbox,
    page_index and tbl. ``unicode`` False skips NFKC where texts are known to be
    normal, which keeps the plan free of Python.
    """
    have = set(items.columns)
    tbl = F.col("tbl") if "tbl" in have else F.lit(None).cast("struct<headers: array<string>, rows: array<array<string>>>")
    bbox = F.col("bbox") if "bbox" in have else F.array().cast("array<double>")
    page = F.col("page_index") if "page_index" in have else F.lit(0)
    norm = T.normalize_text(F.col("text"), unicode)
    base = items.select(*keys, "item_ord", "kind", "heading_level", norm.alias("norm"), bbox.alias("bbox"), page.alias("page_index"),
                        signature_cells(tbl).alias("cells"), F.when(F.col("kind") == "table", tbl).alias("tbl"))
    whole = F.array(F.col("norm"))
    parts = (
        F.when(F.col("cells").isNotNull(), F.col("cells"))
        .when(F.col("kind").isin("table", "heading", "title"), whole)
        .otherwise(T.lines(F.col("norm")))
    )
    lines = base.select("*", F.posexplode(parts).alias("line_ord", "line"), F.size(parts).alias("n_lines")).where("line <> ''")
    number, field, section = T.detect_number(F.col("line")), T.detect_field(F.col("line")), T.detect_section(F.col("line"))
    marked = lines.withColumn("num", number).withColumn("fld", field).withColumn("sec", section)
    body = T.split_body(F.col("line"), F.col("num.prefix"))
    marked = marked.withColumn("body", body).withColumn("body_sec", T.detect_section(F.col("body")))
    rest = T.split_body(F.col("line"), F.col("fld.prefix"))
    cell, head, para = F.col("cells").isNotNull(), F.col("kind").isin("heading", "title"), F.col("kind") == "paragraph"
    section_key = lambda c: F.when(c.isNotNull(), F.concat(F.lit("section:"), c)).otherwise("")
    made = lambda level, number, title, text, key: F.struct(
        F.lit(level).cast("int").alias("level") if isinstance(level, int) else level.cast("int").alias("level"),
        number.alias("number"), title.alias("title"), text.alias("text"), key.alias("field_key"),
    )
    none, line, num = F.lit(""), F.col("line"), F.col("num")
    full = lambda c: F.when(c != "", c).otherwise(line)
    start = (
        F.when(cell, made(0, none, F.col("fld.field_key"), full(rest), F.col("fld.field_key")))
        .when(head & num.isNotNull(), made(F.col("num.level"), F.col("num.number"), full(F.col("body")), full(F.col("body")), section_key(F.col("body_sec"))))
        .when(head, made(F.when(F.col("heading_level") > 0, F.col("heading_level")).otherwise(1), none, line, line, section_key(F.col("sec"))))
        .when(para & num.isNotNull(), made(F.col("num.level"), F.col("num.number"), F.col("body"), F.col("body"), section_key(F.col("body_sec"))))
        .when(para & F.col("fld").isNotNull(), made(0, none, F.col("fld.field_key"), full(rest), F.col("fld.field_key")))
        .when(para & F.col("sec").isNotNull(), made(1, none, F.col("sec"), line, section_key(F.col("sec"))))
    )
    started = marked.withColumn("start", start)
    order = Window.partitionBy(*keys).orderBy("item_ord", "line_ord")
    first = F.row_number().over(order) == 1
    opened = started.withColumn("opens", (F.col("start").isNotNull() | first).cast("int"))
    numbered = opened.withColumn("clause_ord", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    piece = F.when(F.col("start").isNotNull(), F.col("start.text")).otherwise(line)
    box = line_box(F.col("bbox"), F.col("line_ord"), F.col("n_lines"))
    grouped = numbered.groupBy(*keys, "clause_ord").agg(
        F.first("start", ignorenulls=True).alias("s"),
        F.array_sort(F.collect_list(F.struct("item_ord", "line_ord", piece.alias("piece"), F.col("page_index"), box.alias("box"), F.when(F.col("cells").isNull(), F.col("tbl")).alias("tbl")))).alias("pieces"),
    )
    joined = F.array_join(F.filter(F.transform("pieces", lambda p: p["piece"]), lambda t: t != ""), "\n")
    boxed = F.transform(F.filter("pieces", lambda p: F.size(p["box"]) >= 4), lambda p: F.struct(p["page_index"].alias("page_index"), p["box"].alias("bbox")))
    tables = [F.filter(F.transform("pieces", lambda p: p["tbl"]), lambda t: t.isNotNull()).alias("tables")] if "tbl" in have else []
    return grouped.select(
        *keys, "clause_ord", F.coalesce("s.level", F.lit(0)).alias("level"), F.coalesce("s.number", none).alias("number"),
        F.coalesce("s.title", none).alias("title"), joined.alias("text"), F.coalesce("s.field_key", none).alias("field_key"), boxed.alias("boxes"), *tables,
    )
