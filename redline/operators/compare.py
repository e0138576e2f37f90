"""Element comparison, risk and report roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from redline.functions import values as V
from redline.functions.kernels import bag_cosine
from redline.functions.text import normalize_text
from redline.operators import tables as B

PAIR = "pair_id"
RANKS = {"none": 0, "low": 1, "medium": 2, "high": 3}
# Fixed value: the note of the quality gate.
GATE_REASON = "识别质量不足，当前差异仅供人工复核"


def rank(level: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in RANKS.items() for x in p]), level)


def sides(alignments: DataFrame, clauses: DataFrame) -> DataFrame:
    """Alignments with the clauses of both sides: columns w_* and p_*."""
    tables = ["tables"] if "tables" in clauses.columns else []

    def of(side: str, short: str) -> DataFrame:
        return clauses.where(F.col("side") == side).select(
            PAIR, F.col("clause_ord").alias(f"{side}_clause_ord"), *[F.col(c).alias(f"{short}_{c}") for c in ("number", "title", "text", "level", "field_key", *tables)]
        )

    joined = alignments.join(of("word", "w"), [PAIR, "word_clause_ord"], "left")
    return joined.join(of("pdf", "p"), [PAIR, "pdf_clause_ord"], "left")


def exploded_elements(df: DataFrame, text: str, keys: list[str], name: str, unicode: bool = True, with_keywords: bool = True) -> DataFrame:
    norm = df.select(*keys, normalize_text(F.col(text), unicode).alias("norm"))  # apart: no lambda may hold a Python kernel
    return norm.select(*keys, F.explode(V.elements(F.col("norm"), with_keywords)).alias("e")).select(*keys, F.col("e.kind").alias("kind"), F.array_join("e.vals", " | ").alias(name))


def element_changes(pairs: DataFrame, keys: list[str], unicode: bool = True, with_keywords: bool = True) -> DataFrame:
    """keys, kind, word_value, pdf_value, changed: one row for each kind that either text (w_text, p_text) has; equal texts are searched once."""
    norm = lambda c: normalize_text(F.col(c), unicode)
    both = pairs.select(*keys, norm("w_text").alias("wn"), norm("p_text").alias("pn"))
    found = both.select(*keys, "wn", "pn", V.elements(F.col("wn"), with_keywords).alias("w"))
    both = found.select(*keys, "w", F.when(F.col("wn") == F.col("pn"), F.col("w")).otherwise(V.elements(F.col("pn"), with_keywords)).alias("p"))
    kinds = F.array_sort(F.array_union(F.transform("w", lambda e: e["kind"]), F.transform("p", lambda e: e["kind"])))
    value = lambda side, k: F.array_join(F.flatten(F.transform(F.filter(side, lambda e: e["kind"] == k), lambda e: e["vals"])), " | ")
    rows = both.select(*keys, "w", "p", F.explode(kinds).alias("kind"))
    rows = rows.select(*keys, "kind", value("w", F.col("kind")).alias("word_value"), value("p", F.col("kind")).alias("pdf_value"))
    return rows.withColumn("changed", F.col("word_value") != F.col("pdf_value"))


def severe(elements: DataFrame) -> DataFrame:
    return elements.where(F.col("changed") & F.col("kind").isin(V.SEVERE))


def classify(word: Column, pdf: Column, similarity: Column, changed: Column, table_change: Column, identical: float = 0.98, modified: float = 0.85) -> Column:
    """struct(status, risk_level): equal, changed values, changed table, noise, clear change, doubtful change, in this order."""
    out = lambda s, r: F.struct(F.lit(s).alias("status"), F.lit(r).alias("risk_level"))
    table = F.coalesce(table_change, F.lit("")) != ""
    return (
        F.when((word == pdf) & ~table, out("identical", "none")).when(changed, out("modified", "high")).when(table, out("modified", "medium"))
        .when(similarity >= identical, out("identical", "none")).when(similarity < modified, out("modified", "medium")).otherwise(out("modified", "low"))
    )


def unmatched_risk(number: Column) -> Column:
    return F.when(F.coalesce(number, F.lit("")) != "", "high").otherwise("low")


def _tables(paired: DataFrame) -> list[DataFrame]:
    return [paired.select(PAIR, "align_idx", F.posexplode(f"{s}_tables").alias("table_index", "tbl")) for s in ("w", "p")]


def cell_changes(paired: DataFrame, unicode: bool = True) -> DataFrame:
    """pair_id, align_idx, kind, word_value, pdf_value of the changed values in cells of w_tables and p_tables."""
    keys = [PAIR, "align_idx"]
    cells = B.cell_element_changes(*_tables(paired), [*keys, "table_index"], unicode).where("changed")
    return cells.select(*keys, "kind", "word_value", "pdf_value")


def table_changes(paired: DataFrame, unicode: bool = True) -> DataFrame:
    """pair_id, align_idx, table_change (the first one) and table_kinds (one for each changed value of a cell) of w_tables and p_tables."""
    keys = [PAIR, "align_idx"]
    first = B.first_change(*_tables(paired), keys, unicode).select(*keys, F.col("change").alias("table_change"))
    return first.join(cell_changes(paired, unicode).groupBy(*keys).agg(F.array_sort(F.collect_list("kind")).alias("table_kinds")), keys, "full")


def differences(alignments: DataFrame, clauses: DataFrame, identical: float = 0.98, modified: float = 0.85, unicode: bool = True) -> DataFrame:
    """Each alignment with status, risk_level and changed_kinds, in one pass; covered fragments must be gone already.

    Clause texts are normal (``segment`` makes them so); ``unicode`` holds for
    table cells. The similarity of number pairs is taken from the texts; field
    and semantic pairs keep the one of the alignment. Equal texts reach neither
    the value patterns nor the kernel. Clauses with ``tables`` are compared cell
    by cell too, and the tables stay in the result for their segments.
    """
    return judged(sides(alignments, clauses), identical, modified, unicode)


def judged(both: DataFrame, identical: float = 0.98, modified: float = 0.85, unicode: bool = True) -> DataFrame:
    """``differences`` of alignments that have the columns of both sides (w_*, p_*) already."""
    w, p = F.col("word_clause_ord").isNotNull(), F.col("pdf_clause_ord").isNotNull()
    odd = w & p & ~F.col("w_text").eqNullSafe(F.col("p_text"))
    tables = [c for c in ("w_tables", "p_tables") if c in both.columns]
    change, more = F.lit(""), F.array().cast("array<string>")
    if tables:
        both = both.join(table_changes(both.where(w & p), unicode), [PAIR, "align_idx"], "left")
        change, more = F.col("table_change"), F.coalesce("table_kinds", more)
    number = odd & (F.col("match_type") == "number")
    text = lambda c: F.when(number, F.col(c))
    both = both.withColumn("__cos", bag_cosine(text("w_text"), text("p_text")))
    value = F.when(number, F.col("__cos")).when(w & p & (F.col("match_type") == "number"), 1.0).otherwise(F.col("similarity"))
    text = lambda c: F.when(odd, normalize_text(F.col(c), False))
    both = both.withColumn("similarity", value).withColumn("__w", text("w_text")).withColumn("__p", text("p_text"))
    # One plain comparison for each kind: in a lambda over the kinds found, all patterns would run again for each of them.
    kinds = F.array_compact(F.array(*[F.when(V.of_kind(F.col("__w"), k) != V.of_kind(F.col("__p"), k), k) for k in V.KINDS]))
    both = both.withColumn("changed_kinds", F.concat(kinds, more))
    verdict = classify(F.col("w_text"), F.col("p_text"), F.col("similarity"), F.size("changed_kinds") > 0, change, identical, modified)
    alone = F.struct(F.when(w, "deleted").otherwise("added").alias("status"), unmatched_risk(F.coalesce("w_number", "p_number")).alias("risk_level"))
    both = both.withColumn("v", F.when(w & p, verdict).otherwise(alone))
    return both.select(PAIR, "align_idx", "match_type", "similarity", "word_clause_ord", "pdf_clause_ord", F.coalesce("w_number", "p_number").alias("number"),
                       F.coalesce("w_title", "p_title").alias("title"), "w_text", "p_text", "changed_kinds", F.col("v.status").alias("status"), F.col("v.risk_level").alias("risk_level"), *tables)


def overview(diffs: DataFrame, keys: list[str]) -> DataFrame:
    """Overall risk, counts by status and by risk, and the number of changed kinds."""
    n = lambda c: F.count_if(F.expr(c))
    worst = F.max(rank(F.col("risk_level")))
    level = F.when(worst == 3, "high").when(worst == 2, "medium").when(worst == 1, "low").otherwise("clean")
    return diffs.groupBy(*keys).agg(
        level.alias("overall_risk"), F.count("*").alias("total_alignments"),
        *[n(f"status = '{s}'").alias(f"n_{s}") for s in ("identical", "modified", "added", "deleted")],
        *[n(f"risk_level = '{r}'").alias(f"risk_{r}") for r in RANKS], F.sum(F.size("changed_kinds")).alias("key_element_changes"),
    )


def rollup(diffs: DataFrame, *groups: str) -> DataFrame:
    """Counts by group and risk, with subtotals: how a corpus stands."""
    return diffs.rollup(*groups, "risk_level").agg(F.count("*").alias("n"))


def gate(diffs: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Diffs of pairs with an unreliable page: high and medium become low and the note is added once."""
    bad = diagnostics.groupBy(PAIR).agg(F.bool_or(~F.col("reliable")).alias("gated"))
    joined = diffs.join(bad, PAIR, "left").withColumn("gated", F.coalesce("gated", F.lit(False)))
    level = F.when(F.col("gated") & F.col("risk_level").isin("high", "medium"), "low").otherwise(F.col("risk_level"))
    reasons = F.when(F.col("gated"), F.array_union(F.col("risk_reasons"), F.array(F.lit(GATE_REASON)))).otherwise(F.col("risk_reasons"))
    return joined.withColumn("risk_level", level).withColumn("risk_reasons", reasons)


def gate_report(reports: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """recognition_status, overall risk and the unreliable pages (counted from 1) of each pair."""
    pages = diagnostics.groupBy(PAIR).agg(F.array_sort(F.collect_list(F.when(~F.col("reliable"), F.col("page_index") + 1))).alias("unreliable_pages"))
    joined = reports.join(pages, PAIR, "left").withColumn("unreliable_pages", F.coalesce("unreliable_pages", F.array().cast("array<int>")))
    bad = F.size("unreliable_pages") > 0
    return joined.withColumn("recognition_status", F.when(bad, "needs_review").otherwise("reliable")).withColumn(
        "overall_risk", F.when(bad, "needs_review").otherwise(F.col("overall_risk"))
    )


def by_severity(diffs: DataFrame) -> DataFrame:
    """``severity_ord`` from 1 within a pair: high first, then by place."""
    order = Window.partitionBy(PAIR).orderBy(F.desc(rank(F.col("risk_level"))), "align_idx")
    return diffs.withColumn("severity_ord", F.row_number().over(order))
