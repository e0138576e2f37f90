"""What recognisers reply, as blocks: JSON of a model, text with location marks, HTML."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from redline.functions.text import strip
from redline.operators.tables import line_islands, rows_to_table


def tolerant_json(text: Column) -> Column:
    """A VARIANT of a reply's JSON: as it stands without a code fence, else its outermost braces, else its outermost brackets."""
    bare = strip(F.regexp_replace(strip(text), r"(?s)^```[a-zA-Z]*\s*|\s*```$", ""))
    tries = [bare, F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.regexp_extract(bare, r"(?s)\[.*\]", 0)]
    return F.coalesce(*[F.try_parse_json(F.when(t != "", t)) for t in tries])


def reply_blocks(replies: DataFrame, keys: list[str], text: str = "reply", strict: bool = False) -> DataFrame:
    """keys, block_ord, label, content, bbox, tbl of model replies.

    Blocks stand under ``blocks``, ``items`` or at the top; content under
    content or text, the box under bbox or box. What is no object, or blank
    without a table, is dropped. Blank header cells are dropped unless ``strict``.
    """
    v = replies.select(*keys, tolerant_json(F.col(text)).alias("v"))
    listed = F.coalesce(*[F.try_variant_get("v", p, "array<variant>") for p in ("$.blocks", "$.items", "$")])
    rows = v.select(*keys, F.posexplode(listed).alias("n", "b")).where("schema_of_variant(b) like 'OBJECT%'")
    get = lambda p, t: F.try_variant_get("b", p, t)
    content = strip(F.coalesce(get("$.content", "string"), get("$.text", "string"), F.lit("")))
    box = F.coalesce(get("$.bbox", "array<double>"), get("$.box", "array<double>"), F.array().cast("array<double>"))
    label = F.lower(F.coalesce(get("$.label", "string"), F.lit("text")))
    flat = lambda c: strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]+", " "))
    heads = F.transform(F.coalesce(get("$.table.headers", "array<string>"), F.array().cast("array<string>")), flat)
    heads = heads if strict else F.filter(heads, lambda h: h != "")
    lists = F.transform(F.coalesce(get("$.table.rows", "array<variant>"), F.array().cast("array<variant>")), lambda r: F.try_variant_get(r, "$", "array<string>"))
    data = F.transform(F.filter(lists, lambda r: r.isNotNull()), lambda r: F.transform(r, flat))
    table = F.when((label == "table") & ((F.size(heads) > 0) | (F.size(data) > 0)), F.struct(heads.alias("headers"), data.alias("rows")))
    made = rows.select(*keys, "n", label.alias("label"), content.alias("content"), box.alias("bbox"), table.alias("tbl")).where("content <> '' or tbl is not null")
    order = Window.partitionBy(*keys).orderBy("n")
    return made.withColumn("block_ord", F.row_number().over(order) - 1).drop("n")


def location_lines(pages: DataFrame, keys: list[str], text: str = "content", width: str = "pdf_width_pt", height: str = "pdf_height_pt") -> DataFrame:
    """keys, line_ord, line, bbox of text whose lines may end in location marks (eight or more: a box in page points)."""
    rows = pages.select(*keys, width, height, F.posexplode(F.split(text, r"\r\n|[\n\r]")).alias("line_ord", "raw"))
    marks = F.transform(F.regexp_extract_all("raw", F.lit(r"<\|LOC_(\d+)\|>"), F.lit(1)), lambda x: x.cast("double"))
    at = lambda i, page: F.get(marks, F.lit(i)) * F.col(page) / 1000
    box = F.when(F.size(marks) >= 8, F.array(at(0, width), at(1, height), at(4, width), at(5, height))).otherwise(F.array().cast("array<double>"))
    return rows.select(*keys, "line_ord", strip(F.regexp_replace("raw", r"<\|LOC_\d+\|>", "")).alias("line"), box.alias("bbox"))


class _Blocks(HTMLParser):
    """Paragraphs, list items and tables of a page, in order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str, list | None]] = []
        self.text: list[str] = []
        self.rows: list[list[str]] | None = None
        self.cell: list[str] | None = None
        self.skip = 0
        self.keep: list[list[str]] | None = None  # every row, where they are asked for

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.blocks.append(("text", text, None))

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "table":
            self.flush()
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
            if self.keep is not None:
                self.keep.append(self.rows[-1])
        elif tag in ("td", "th") and self.rows is not None:
            if not self.rows:
                self.rows.append([])
            self.cell = []
        elif tag == "br":
            (self.cell if self.cell is not None else self.text).append(" ")
        elif tag in ("p", "li", "div", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "body"):
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag in ("td", "th") and self.cell is not None:
            self.rows[-1].append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "table" and self.rows is not None:
            rows = [r for r in self.rows if any(r)]
            if rows:
                self.blocks.append(("table", "\n".join(" | ".join(r) for r in rows), rows))
            self.rows = None
        elif tag in ("p", "li", "div", "h1", "h2", "h3", "h4", "h5", "h6"):
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            (self.cell if self.cell is not None else self.text).append(data)


def parse_html(html: str | None) -> list[tuple[str, str, list | None]]:
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.blocks


def html_blocks(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, block_ord, label (text or table), content, n_rows, n_cols of each page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (k, n, label, content, len(rows or []), max((len(r) for r in rows or []), default=0))
                for k, page in zip(batch[key], batch[html], strict=True)
                for n, (label, content, rows) in enumerate(parse_html(page))
            ]
            yield pd.DataFrame(rows, columns=[key, "block_ord", "label", "content", "n_rows", "n_cols"])

    return pages.select(key, html).mapInPandas(run, f"{key} long, block_ord int, label string, content string, n_rows int, n_cols int")


_TABLE = r"(?is)<table\b.*?</table\s*>"


def _table_rows(html: str) -> list[list[str]]:
    """All rows that have cells, blank ones too."""
    parser = _Blocks()
    parser.rows = []
    parser.keep = []
    parser.feed(html)
    parser.close()
    return [r for r in parser.keep if r]


@pandas_udf(ArrayType(ArrayType(StringType())))
def table_rows(html: pd.Series) -> pd.Series:
    return html.map(lambda h: _table_rows(h or ""))


def plain_blocks(pages: DataFrame, keys: list[str], text: str = "content") -> DataFrame:
    """Blocks of plain replies: keys, block_ord, block_id, label, content, tbl. The last key is the page's index.

    HTML tables are islands between runs of lines; runs with pipes or tabs are
    tables too, other lines a block each. An HTML table of under two columns
    stays as text. Blocks are numbered by page.
    """
    parts = F.split(F.coalesce(text, F.lit("")), _TABLE)
    islands = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_TABLE), F.lit(0))
    between = pages.select(*keys, F.posexplode(parts).alias("n", "part")).withColumn("seg", 2 * F.col("n"))
    lines = between.select(*keys, "seg", F.posexplode(F.split("part", r"\r\n|[\n\r]")).alias("line_ord", "line"))
    lines = line_islands(lines, [*keys, "seg"]).select(*keys, "seg", F.col("first_ord").alias("at"), "label", "content", "tbl")
    html = pages.select(*keys, F.posexplode(islands).alias("n", "raw")).withColumn("rows", table_rows("raw"))
    html = html.select(*keys, (2 * F.col("n") + 1).alias("seg"), F.lit(0).alias("at"), strip(F.col("raw")).alias("raw"), rows_to_table(F.col("rows")).alias("tbl"))
    content = F.array_join(F.transform(F.concat(F.array("tbl.headers"), F.col("tbl.rows")), lambda r: F.array_join(r, " | ")), "\n")
    found = F.col("tbl").isNotNull()
    html = html.select(*keys, "seg", "at", F.when(found, "table").otherwise("text").alias("label"), F.when(found, content).otherwise(F.col("raw")).alias("content"), "tbl")
    order = Window.partitionBy(*keys).orderBy("seg", "at")
    numbered = lines.unionByName(html).withColumn("block_ord", F.row_number().over(order) - 1)
    name = F.concat(F.lit("p"), F.col(keys[-1]), F.lit("-b"), F.col("block_ord"))
    return numbered.select(*keys, "block_ord", name.alias("block_id"), "label", "content", "tbl")


def parse_counts(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks, tables and blocks with a box (where blocks have one) of each page."""
    boxed = F.size("bbox") >= 4 if "bbox" in blocks.columns else F.lit(False)
    return blocks.groupBy(*keys).agg(F.count("*").alias("n_blocks"), F.count_if(F.col("label") == "table").alias("n_tables"), F.count_if(boxed).alias("n_boxed"))


def backoff(attempt: int, jitter: float = 0.0) -> float:
    """Seconds before the next attempt, from 0: doubled each time up to eight, and some more."""
    return min(2.0**attempt, 8.0) + jitter


def retried(call: Callable, retries: int = 3, sleep: Callable[[float], None] = time.sleep, jitter: Callable[[], float] = random.random) -> Callable:
    """``call`` tried again after ConnectionError or TimeoutError; the last error is raised."""

    def run(*args):
        for attempt in range(retries + 1):
            try:
                return call(*args)
            except (ConnectionError, TimeoutError):
                if attempt == retries:
                    raise
                sleep(backoff(attempt, jitter()))

    return run


def recognise(pages: DataFrame, recogniser: Callable[[bytes], str], most: int | None = None, retries: int = 3) -> DataFrame:
    """page_id, reply and cut of an injected recogniser for pages (page_id, image): one call a page, tried again when the connection fails.

    ``cut`` marks replies of ``most`` characters or more, which the recogniser may not have ended.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = retried(recogniser, retries)
        for batch in batches:
            replies = [ask(x) for x in batch["image"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "reply": replies, "cut": [most is not None and len(r or "") >= most for r in replies]})

    return pages.select("page_id", "image").mapInPandas(run, "page_id long, reply string, cut boolean")


def embed(texts: DataFrame, text: str, embedder: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """``texts`` with ``embedding``; each distinct text is sent once, a batch in one request, tried again when the connection fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = retried(embedder)
        for batch in batches:
            yield pd.DataFrame({text: batch[text], "embedding": ask(batch[text].tolist())})

    made = texts.select(text).distinct().mapInPandas(run, f"`{text}` string, embedding array<double>")
    return texts.join(made, text, "left")
