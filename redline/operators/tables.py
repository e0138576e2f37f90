"""Tables: from text to structure, cell by cell comparison, first change, diff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from redline.functions import values as V
from redline.functions.kernels import table_diff
from redline.functions.text import compact, is_rule_line, let, normalize_text, strip

TABLE = "struct<headers: array<string>, rows: array<array<string>>>"
none_table = lambda: F.lit(None).cast(TABLE)


def canonical_rows(rows: Column) -> Column:
    """Trailing blank cells dropped; a row of two filled cells or fewer keeps those alone."""
    def one(row: Column) -> Column:
        filled = F.filter(F.sequence(F.lit(1), F.size(row)), lambda i: F.element_at(row, i) != "")
        kept = F.filter(row, lambda c: c != "")
        return F.when(F.size(row) == 0, row).when(F.size(filled) <= 2, kept).otherwise(F.slice(row, 1, F.array_max(filled)))

    return F.transform(rows, one)


def collapse_repeats(rows: Column, least: int = 4) -> Column:
    """Runs of ``least`` or more equal data rows become one row; the first row is the header and stays apart."""
    def collapsed(data: Column) -> Column:
        n = F.size(data)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | ~F.get(data, i).eqNullSafe(F.get(data, i - 1)))

        def runs(at: Column) -> Column:
            ends = F.concat(F.slice(at, 2, F.size(at)), F.array(n))
            return F.flatten(F.zip_with(at, ends, lambda a, b: F.slice(data, a + 1, F.when(b - a >= least, 1).otherwise(b - a))))

        return let(starts, runs)

    return let(rows, lambda r: F.when(F.size(r) < 2, r).otherwise(F.concat(F.slice(r, 1, 1), let(F.slice(r, 2, F.size(r)), collapsed))))


def rows_to_table(rows: Column) -> Column:
    """Ragged rows padded to the widest; fewer than two columns are no table."""
    def table(width: Column, r: Column) -> Column:
        padded = F.transform(r, lambda x: F.concat(x, F.array_repeat(F.lit(""), width - F.size(x))))
        made = let(padded, lambda p: F.struct(F.get(p, F.lit(0)).alias("headers"), F.slice(p, 2, F.size(p)).alias("rows")))
        return F.when((F.size(r) > 0) & (width >= 2), made)

    return let(rows, lambda r: let(F.coalesce(F.array_max(F.transform(r, lambda x: F.size(x))), F.lit(0)), lambda w: table(w, r)))


def delimited_table(text: Column) -> Column:
    """Markdown, 'cell | cell' or tab-separated text as a table, or null; inner and leading blank cells stay."""
    def cells(line: Column, wrapped: Column) -> Column:
        bare = F.when(wrapped, F.regexp_replace(F.regexp_replace(line, r"^\|", ""), r"\|$", "")).otherwise(line)
        parts = F.split(bare, F.when(line.contains("\t") & ~line.contains("|"), F.lit("\t")).otherwise(F.lit(r"\|")))
        return F.transform(parts, lambda x: strip(x))

    def table(lines: Column) -> Column:
        wraps = lambda h: ~h.contains("\t") & h.startswith("|") & h.endswith("|")
        rows = let(wraps(F.get(lines, F.lit(0))), lambda w: F.transform(lines, lambda x: cells(x, w)))
        filled = F.filter(rows, lambda r: F.exists(r, lambda c: c != ""))
        return F.when(F.size(lines) > 0, rows_to_table(collapse_repeats(filled)))

    stripped = F.transform(F.split(text, r"\r\n|[\n\r]"), lambda x: strip(x))
    return let(F.filter(stripped, lambda x: (x != "") & ~is_rule_line(x)), table)


def line_islands(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks of an OCR page: runs of lines with a pipe or tab (blank lines don't count) that make a table, and single text lines.

    ``lines``: keys, line_ord, line. Returns keys, first_ord, last_ord, label, content, tbl.
    """
    kept = lines.withColumn("line", strip(F.col("line"))).where("line <> ''").withColumn("is_table", F.col("line").rlike(r"[|\t]"))
    order = Window.partitionBy(*keys).orderBy("line_ord")
    change = F.coalesce((F.col("is_table") != F.lag("is_table").over(order)) | ~F.col("is_table"), F.lit(True))
    runs = kept.withColumn("change", change).withColumn("island", F.sum(F.col("change").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = runs.groupBy(*keys, "island").agg(
        F.min("line_ord").alias("first_ord"), F.max("line_ord").alias("last_ord"), F.bool_or("is_table").alias("is_table"),
        F.array_sort(F.collect_list(F.struct("line_ord", "line"))).alias("ls"),
    )
    text = F.array_join(F.transform("ls", lambda x: x["line"]), "\n")
    table = F.when(F.col("is_table") & (F.size("ls") >= 2), delimited_table(text))
    found = grouped.withColumn("tbl", table).withColumn("tbl", F.when(F.size("tbl.rows") > 0, F.col("tbl")))
    content = F.array_join(F.transform(F.concat(F.array("tbl.headers"), F.col("tbl.rows")), lambda r: F.array_join(r, " | ")), "\n")
    tables = found.where("tbl is not null").select(*keys, "first_ord", "last_ord", F.lit("table").alias("label"), content.alias("content"), "tbl")
    plain = found.where("tbl is null").select(*keys, F.explode("ls").alias("x"))
    plain = plain.select(*keys, F.col("x.line_ord").alias("first_ord"), F.col("x.line_ord").alias("last_ord"), F.lit("text").alias("label"),
                         F.col("x.line").alias("content"), none_table().alias("tbl"))
    return tables.unionByName(plain)


def cells(tables: DataFrame, keys: list[str], tbl: str = "tbl") -> DataFrame:
    """keys, row_index, col_index, col_header, cell of the data rows."""
    rows = tables.select(*keys, F.col(f"{tbl}.headers").alias("headers"), F.posexplode(f"{tbl}.rows").alias("row_index", "row"))
    one = rows.select(*keys, "headers", "row_index", F.posexplode("row").alias("col_index", "cell"))
    return one.select(*keys, "row_index", "col_index", F.coalesce(F.get("headers", F.col("col_index")), F.lit("")).alias("col_header"), "cell")


def cell_elements(tables: DataFrame, keys: list[str], unicode: bool = True) -> DataFrame:
    """High-risk values of each cell: keys, row_index, col_index, col_header, kind, vals."""
    norm = cells(tables, keys).withColumn("norm", normalize_text(F.col("cell"), unicode))
    rows = norm.select("*", F.explode(V.elements(F.col("norm"), with_keywords=False)).alias("e"))
    return rows.select(*keys, "row_index", "col_index", "col_header", F.col("e.kind").alias("kind"), F.array_join("e.vals", " | ").alias("vals"))


def cell_element_changes(word: DataFrame, pdf: DataFrame, keys: list[str], unicode: bool = True) -> DataFrame:
    """Values of cells in the same place on both sides; places that one side lacks are left to the table diff."""
    place = [*keys, "row_index", "col_index"]
    width = lambda df, n: df.select(*keys, F.col("tbl.headers").alias(n))
    heads = width(word, "hw").join(width(pdf, "hp"), keys).select(*keys, F.when(F.size("hw") >= F.size("hp"), F.col("hw")).otherwise(F.col("hp")).alias("heads"))
    both = cells(word, keys).select(*place, F.col("cell").alias("w")).join(cells(pdf, keys).select(*place, F.col("cell").alias("p")), place)
    both = both.withColumn("w", normalize_text(F.col("w"), unicode)).withColumn("p", normalize_text(F.col("p"), unicode))
    both = both.withColumn("we", V.elements(F.col("w"), with_keywords=False)).withColumn("pe", V.elements(F.col("p"), with_keywords=False))
    kinds = F.array_sort(F.array_union(F.transform("we", lambda e: e["kind"]), F.transform("pe", lambda e: e["kind"])))
    value = lambda side: F.array_join(F.flatten(F.transform(F.filter(side, lambda e: e["kind"] == F.col("kind")), lambda e: e["vals"])), " | ")
    rows = both.join(heads, keys).select(*place, "heads", "we", "pe", F.explode(kinds).alias("kind"))
    rows = rows.withColumn("word_value", value(F.col("we"))).withColumn("pdf_value", value(F.col("pe")))
    header = F.coalesce(F.get("heads", F.col("col_index")), F.lit(""))
    return rows.select(*place, header.alias("col_header"), "kind", "word_value", "pdf_value", (F.col("word_value") != F.col("pdf_value")).alias("changed"))


def first_change(word: DataFrame, pdf: DataFrame, keys: list[str], unicode: bool = True) -> DataFrame:
    """keys, change of the first difference in (table, header before rows, row, column) order.

    ``word`` and ``pdf``: keys, table_index, tbl. Changes: table_missing,
    table_added, header, row_missing, row_added, cell_missing, cell_added,
    cell_changed; with row_index, col_index and the word header's name.
    """
    count = lambda df, n: df.groupBy(*keys).agg(F.count("*").alias(n))
    counts = count(word, "nw").join(count(pdf, "np"), keys, "full").fillna(0, ["nw", "np"])
    table_kind = F.when(F.col("nw") > F.col("np"), "table_missing").otherwise("table_added")
    where = [F.lit(-1).alias("table_index"), F.lit(0).alias("phase"), F.lit(-1).alias("row_index"), F.lit(-1).alias("col_index")]
    tables = counts.where("nw <> np").select(*keys, *where, table_kind.alias("change"), F.lit("").alias("col_header"))
    same = counts.where("nw = np").select(*keys)
    w = word.join(same, keys).select(*keys, "table_index", F.col("tbl").alias("w"))
    p = pdf.join(same, keys).select(*keys, "table_index", F.col("tbl").alias("p"))
    both = w.join(p, [*keys, "table_index"])
    key = lambda c: F.transform(c, lambda x: F.regexp_replace(x, r"(?U)\s+", ""))
    heads = both.where(~key(F.col("w.headers")).eqNullSafe(key(F.col("p.headers"))))
    heads = heads.select(*keys, "table_index", F.lit(0).alias("phase"), F.lit(-1).alias("row_index"), F.lit(-1).alias("col_index"),
                         F.lit("header").alias("change"), F.lit("").alias("col_header"))
    n_rows = F.greatest(F.size("w.rows"), F.size("p.rows"))
    rows = both.where(n_rows > 0).select(*keys, "table_index", "w", "p", F.explode(F.sequence(F.lit(0), n_rows - 1)).alias("row_index"))
    rows = rows.select(*keys, "table_index", "row_index", F.col("w.headers").alias("heads"), F.get("w.rows", F.col("row_index")).alias("wr"), F.get("p.rows", F.col("row_index")).alias("pr"))
    odd = rows.where("wr is null or pr is null").select(
        *keys, "table_index", F.lit(1).alias("phase"), "row_index", F.lit(-1).alias("col_index"),
        F.when(F.col("pr").isNull(), "row_missing").otherwise("row_added").alias("change"), F.lit("").alias("col_header"),
    )
    paired = rows.where("wr is not null and pr is not null")
    n_cols = F.greatest(F.size("wr"), F.size("pr"))
    cols = paired.where(n_cols > 0).select(*keys, "table_index", "row_index", "heads", "wr", "pr", F.explode(F.sequence(F.lit(0), n_cols - 1)).alias("col_index"))
    cell = lambda c: compact(F.coalesce(F.get(c, F.col("col_index")), F.lit("")), unicode)
    cols = cols.withColumn("wk", cell(F.col("wr"))).withColumn("pk", cell(F.col("pr"))).where("wk <> pk")
    kind = F.when(F.col("pk") == "", "cell_missing").when(F.col("wk") == "", "cell_added").otherwise("cell_changed")
    cols = cols.select(*keys, "table_index", F.lit(1).alias("phase"), "row_index", "col_index", kind.alias("change"),
                       F.coalesce(F.get("heads", F.col("col_index")), F.concat(F.lit("第"), F.col("col_index") + 1, F.lit("列"))).alias("col_header"))
    found = tables.unionByName(heads).unionByName(odd).unionByName(cols)
    place = F.struct("table_index", "phase", "row_index", "col_index")
    first = found.groupBy(*keys).agg(F.min_by(F.struct("table_index", "row_index", "col_index", "change", "col_header"), place).alias("f"))
    return first.select(*keys, "f.*")


def diff_segments(pairs: DataFrame, word: str = "word_tbl", pdf: str = "pdf_tbl") -> DataFrame:
    """``pairs`` with the segments of the two tables; equal tables never reach the matcher."""
    texts = lambda c: F.transform(F.concat(F.array(f"{c}.headers"), F.col(f"{c}.rows")), lambda r: F.array_join(r, " | "))
    changed = pairs.where(~F.col(word).eqNullSafe(F.col(pdf)))
    return changed.withColumn("segments", table_diff(texts(word), texts(pdf)))


def structure_checks(tables: DataFrame, keys: list[str]) -> DataFrame:
    """Per table: columns, ragged rows, and whether most rows are sparse (filled under 0.35 of the width)."""
    rows, width = F.col("tbl.rows"), F.size("tbl.headers")
    uneven = F.size(F.filter(rows, lambda r: F.size(r) != width))
    sparse = F.size(F.filter(rows, lambda r: F.size(F.filter(r, lambda c: F.trim(c) != "")) / width < 0.35))
    return tables.select(*keys, width.alias("n_cols"), F.size(rows).alias("n_rows"), uneven.alias("n_uneven"), sparse.alias("n_sparse"),
                         F.when(F.size(rows) > 0, sparse / F.size(rows) > 0.5).otherwise(False).alias("mostly_sparse"))
