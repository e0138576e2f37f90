"""Word files: document-order items from the zipped XML, read on the executors."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from redline.functions.text import normalize_table_text

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_heading = re.compile(r"heading\s*(\d+)", re.I)
ITEM = "item_ord int, kind string, heading_level int, text string, tbl struct<headers: array<string>, rows: array<array<string>>>"


def paragraph_text(p: ElementTree.Element) -> str:
    marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    return "".join(e.text or "" if e.tag == f"{_W}t" else marks.get(e.tag, "") for e in p.iter())


def cell_text(cell: ElementTree.Element) -> str:
    return " ".join(paragraph_text(p) for p in cell.iter(f"{_W}p")).replace("\n", " ").strip()


def table_rows(table: ElementTree.Element) -> list[list[str]]:
    """A horizontally merged cell is one physical cell; a vertically merged one goes on as blank."""
    return [[cell_text(c) for c in row.findall(f"{_W}tc")] for row in table.findall(f"{_W}tr")]


def style_names(archive: zipfile.ZipFile) -> dict[str, str]:
    if "word/styles.xml" not in archive.namelist():
        return {}
    root = ElementTree.fromstring(archive.read("word/styles.xml"))
    names = {s.get(f"{_W}styleId"): s.find(f"{_W}name") for s in root.iter(f"{_W}style")}
    return {k: n.get(f"{_W}val", "") for k, n in names.items() if k and n is not None}


def parse(content: bytes) -> list[dict]:
    """The items of one file: paragraphs and tables of the body in order, blank paragraphs left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        styles = style_names(archive)
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
    out: list[dict] = []
    for e in body if body is not None else []:
        item = {"kind": "paragraph", "heading_level": 0, "text": "", "tbl": None}
        if e.tag == f"{_W}p":
            item["text"] = paragraph_text(e)
            ref = e.find(f"{_W}pPr/{_W}pStyle")
            style = styles.get(ref.get(f"{_W}val"), ref.get(f"{_W}val")) if ref is not None else ""
            if "heading" in style.lower() or "title" in style.lower():
                level = _heading.search(style)
                item |= {"kind": "heading", "heading_level": int(level[1]) if level else 1}
            if not item["text"].strip():
                continue
        elif e.tag == f"{_W}tbl":
            rows = table_rows(e)
            if not any(c for r in rows for c in r):
                continue
            item |= {"kind": "table", "text": "\n".join(" | ".join(r) for r in rows), "tbl": {"headers": rows[0], "rows": rows[1:]}}
        else:
            continue
        out.append(item | {"item_ord": len(out)})
    return out


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """path and items of every .docx under ``path``; an unreadable file gives one row of kind ``error``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows += [item | {"path": name} for item in parse(content)]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    rows.append({"path": name, "item_ord": 0, "kind": "error", "heading_level": 0, "text": str(e), "tbl": None})
            yield pd.DataFrame(rows, columns=["path", "item_ord", "kind", "heading_level", "text", "tbl"])

    items = files.select("path", "content").mapInPandas(run, f"path string, {ITEM}")
    # tables in the form that other sources of tables have, so that two of one content are equal
    table, whole = F.col("kind") == "table", F.when(F.col("kind") == "table", normalize_table_text(F.col("text"))).otherwise(F.col("text"))
    rows = F.transform(F.split("text", "\n"), lambda line: F.split(line, r" \| "))
    tbl = F.when(table, F.struct(F.get(rows, F.lit(0)).alias("headers"), F.slice(rows, 2, F.size(rows)).alias("rows")))
    return items.withColumn("text", whole).where(~table | (F.col("text") != "")).withColumn("tbl", tbl)


def paragraphs(content: bytes) -> list[str]:
    """All paragraphs of one file, blank ones too: those of the body, then those in cells of tables; shades are set by these places."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
    if body is None:
        return []
    inner = [p for t in body.findall(f"{_W}tbl") for p in t.iter(f"{_W}p")]
    return [paragraph_text(p) for p in [*body.findall(f"{_W}p"), *inner]]


def read_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """path, para_ord (from 0) and text of the paragraphs of every .docx under ``path``; unreadable files have none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows += [(name, n, text) for n, text in enumerate(paragraphs(content))]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    continue
            yield pd.DataFrame(rows, columns=["path", "para_ord", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, para_ord int, text string")


def summary(items: DataFrame, keys: list[str]) -> DataFrame:
    """Items by kind, headings by level, characters, table sizes of each document."""
    n = lambda k: F.count_if(F.col("kind") == k).alias(f"n_{k}")
    level = F.col("heading_level")
    levels = F.map_from_entries(F.array_sort(F.collect_set(F.when(F.col("kind") == "heading", F.struct(level.alias("level"), F.col("__n").alias("n"))))))
    counted = items.withColumn("__n", F.count("*").over(Window.partitionBy(*keys, "kind", "heading_level")))
    return counted.groupBy(*keys).agg(n("paragraph"), n("heading"), n("table"), levels.alias("heading_levels"), F.sum(F.length("text")).alias("chars"),
                                      F.max(F.size("tbl.rows")).alias("most_rows"), F.max(F.size("tbl.headers")).alias("most_columns"))
