"""Whole comparisons over batches of document pairs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from redline.config import CompareConfig
from redline.functions.kernels import char_diff
from redline.functions.geometry import region
from redline.functions.text import normalize_text
from redline.lineage import materialized
from redline.operators import align as A, clauses as C, compare as R, rawdiff as D, tables as B
from redline.schemas import REGIONS, REPORT

PAIR = "pair_id"


@dataclass
class Comparison:
    """The tables of a standard comparison. Clauses and diffs are checkpointed, since later steps read them several times, unless ``keep`` was False."""

    clauses: DataFrame
    alignments: DataFrame
    diffs: DataFrame
    reports: DataFrame


def compare(items: DataFrame, diagnostics: DataFrame | None = None, config: CompareConfig | None = None, unicode: bool = True, keep: bool = True) -> Comparison:
    """Items (pair_id, side, item_ord, kind, heading_level, text, …) to clauses, alignments, diffs and reports."""
    return _compared(C.segment(items, [PAIR, "side"], unicode), diagnostics, config, unicode, keep)


def compare_clauses(clauses: DataFrame, diagnostics: DataFrame | None = None, config: CompareConfig | None = None, unicode: bool = True, keep: bool = True) -> Comparison:
    """Clauses that were made elsewhere: their texts are made normal first, unless ``unicode`` is False.

    ``keep=False`` writes no checkpoints: for callers that read one table of the result, once.
    """
    normal = clauses.withColumn("text", normalize_text(F.col("text"))) if unicode else clauses
    return _compared(normal, diagnostics, config, unicode, keep, clauses if unicode and not keep else None)


def _compared(clauses: DataFrame, diagnostics: DataFrame | None, config: CompareConfig | None, unicode: bool, keep: bool, raw: DataFrame | None = None) -> Comparison:
    """``clauses``: normal texts, for which the later steps need no NFKC; ``unicode`` holds for the cells of tables.

    ``raw``: the clauses before, where their texts are made normal in the task that matches them (a kernel before it would deal
    their texts out anew).
    """
    config = config or CompareConfig()
    kept = materialized if keep else lambda df: df
    clauses = kept(clauses)
    both = A.matched(clauses if raw is None else raw, config.align_similarity_bag, config.neighbourhood, config.semantic, config.fragment_min_chars, raw is not None)
    alignments = both.select(PAIR, *A.ALIGNMENT)
    diffs = kept(R.judged(both.where("not covered").drop("covered"), config.similarity_identical, config.similarity_modified, unicode))
    reports = R.overview(diffs, [PAIR])
    diffs = diffs.withColumn("risk_reasons", F.transform("changed_kinds", lambda k: F.concat(F.lit("changed: "), k)))
    if diagnostics is not None:
        diffs = R.gate(diffs, diagnostics)
        reports = R.gate_report(reports, diagnostics)
    return Comparison(clauses, alignments, diffs, reports)


def compare_briefly(clauses: DataFrame, config: CompareConfig | None = None, unicode: bool = True, together: bool = False) -> DataFrame:
    """The verdicts of ``compare_clauses``: pair_id, align_idx, status, risk_level, number, changed_kinds and risk_reasons of its diffs.

    For callers that need neither texts nor similarities; clauses with tables are compared in full. ``together``: see ``align.matched``.
    """
    config = config or CompareConfig()
    if "tables" in clauses.columns:
        diffs = compare_clauses(clauses, None, config, unicode, keep=False).diffs
        return diffs.select(PAIR, "align_idx", "status", "risk_level", "number", "changed_kinds", "risk_reasons")
    diffs = A.verdicts(clauses, config.align_similarity_bag, config.neighbourhood, config.semantic, config.fragment_min_chars, unicode, together,
                       config.similarity_identical, config.similarity_modified)
    return diffs.withColumn("risk_reasons", F.transform("changed_kinds", lambda k: F.concat(F.lit("changed: "), k)))


def with_segments(diffs: DataFrame) -> DataFrame:
    """Modified pairs with their character segments, then those of their tables; identical and unmatched ones never reach the matcher."""
    modified, keys = diffs.where("status = 'modified'"), [PAIR, "align_idx"]
    found = modified.withColumn("segments", char_diff("w_text", "p_text"))
    if "w_tables" not in diffs.columns:
        return found
    tables = modified.select(*keys, F.posexplode(F.arrays_zip("w_tables", "p_tables")).alias("table_index", "t"))
    tables = tables.select(*keys, "table_index", F.col("t.w_tables").alias("word_tbl"), F.col("t.p_tables").alias("pdf_tbl"))
    rows = B.diff_segments(tables.where("word_tbl is not null and pdf_tbl is not null")).select(*keys, F.struct("table_index", "segments").alias("x"))
    rows = rows.groupBy(*keys).agg(F.flatten(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["segments"])).alias("__more"))
    more = F.when(F.col("__more").isNull(), F.col("segments")).otherwise(F.concat("segments", "__more"))
    return found.join(rows, keys, "left").withColumn("segments", more).drop("__more")


def report_documents(result: Comparison, page_meta: DataFrame | None = None) -> DataFrame:
    """One row for each pair in the shape of ``schemas.REPORT``: what the report of a pair says, ready to be saved.

    ``diffs`` are the modified pairs with their segments, ``unmatched`` the added
    and deleted clauses, both in the order of the alignments; identical pairs
    are counted alone. Regions (shares of a page) need clauses with boxes and
    ``page_meta`` (pair_id, page_index, pdf_width_pt, pdf_height_pt).
    """
    keys = [PAIR, "align_idx"]
    whole = lambda op, c: F.array(F.struct(F.lit(op).alias("op"), F.col(c).alias("text")))
    alone = result.diffs.where("status in ('added', 'deleted')")
    alone = alone.withColumn("segments", F.when(F.col("status") == "added", whole("insert", "p_text")).otherwise(whole("delete", "w_text")))
    shown = with_segments(result.diffs).unionByName(alone)
    judged = F.col("judged_by") if "judged_by" in shown.columns else F.lit("rule")
    shown = shown.join(_regions(result.clauses, page_meta), [PAIR, "pdf_clause_ord"], "left") if page_meta is not None else shown.withColumn("page_regions", F.lit(None))
    regions = F.coalesce(F.col("page_regions").cast(REGIONS), F.array().cast(REGIONS))
    name = F.concat(F.lit("al"), F.col("align_idx"))
    row = F.struct("align_idx", name.alias("alignment_id"), "status", "risk_level", "risk_reasons", judged.alias("judged_by"), "number", "title", "segments", regions.alias("page_regions"))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, row))), lambda x: x.dropFields("align_idx"))
    lists = shown.groupBy(PAIR).agg(listed(F.col("status") == "modified").alias("diffs"), listed(F.col("status") != "modified").alias("unmatched"))
    changes = R.element_changes(result.diffs.where("status = 'modified' and not w_text <=> p_text"), keys, unicode=False).where("changed")
    if "w_tables" in result.diffs.columns:
        changes = changes.drop("changed").unionByName(R.cell_changes(result.diffs.where("status = 'modified'")))
    element = F.struct("align_idx", "kind", "word_value", "pdf_value")
    elements = changes.groupBy(PAIR).agg(F.array_sort(F.collect_list(element)).alias("es"))
    named = F.transform("es", lambda e: F.struct(F.concat(F.lit("al"), e["align_idx"]).alias("alignment_id"), e["kind"].alias("kind"), e["word_value"].alias("word_value"), e["pdf_value"].alias("pdf_value")))
    reports = result.reports
    for c, default in (("recognition_status", F.lit("reliable")), ("unreliable_pages", F.array().cast("array<int>"))):
        if c not in reports.columns:
            reports = reports.withColumn(c, default)
    counts = lambda prefix, names: F.map_filter(F.create_map(*[x for n in names for x in (F.lit(n), F.col(f"{prefix}_{n}"))]), lambda k, v: v > 0)
    joined = reports.join(lists, PAIR, "left").join(elements.select(PAIR, named.alias("key_elements")), PAIR, "left")
    joined = joined.withColumn("status_counts", counts("n", ("identical", "modified", "added", "deleted"))).withColumn("risk_distribution", counts("risk", R.RANKS))
    return joined.select(*[F.coalesce(F.col(f.name), F.array().cast(f.dataType)).alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(REPORT)])


def _regions(clauses: DataFrame, page_meta: DataFrame) -> DataFrame:
    """pair_id, pdf_clause_ord, page_regions of the pdf clauses' boxes; boxes without a page or an area have none."""
    boxes = clauses.where("side = 'pdf'").select(PAIR, F.col("clause_ord").alias("pdf_clause_ord"), F.posexplode("boxes").alias("n", "b"))
    boxes = boxes.select(PAIR, "pdf_clause_ord", "n", F.col("b.page_index").cast("int").alias("page_index"), F.col("b.bbox").alias("box"))
    on_page = boxes.join(page_meta.select(PAIR, "page_index", "pdf_width_pt", "pdf_height_pt"), [PAIR, "page_index"])
    share = on_page.withColumn("bbox", region(F.col("box"), F.col("pdf_width_pt"), F.col("pdf_height_pt"))).where("bbox is not null")
    rows = share.groupBy(PAIR, "pdf_clause_ord").agg(F.array_sort(F.collect_list(F.struct("n", "page_index", "bbox"))).alias("rs"))
    return rows.select(PAIR, "pdf_clause_ord", F.transform("rs", lambda r: r.dropFields("n")).alias("page_regions"))


def locate_targets(diffs: DataFrame) -> DataFrame:
    """What is looked for in the trusted text: modified pairs and deleted clauses, with pair_id, target_id, number, text, status and risk_level."""
    found = diffs.where("status in ('modified', 'deleted')")
    return found.select(PAIR, F.col("align_idx").alias("target_id"), F.coalesce("number", F.lit("")).alias("number"), F.col("w_text").alias("text"), "status", "risk_level")


def view_counts(reports: DataFrame) -> DataFrame:
    """pair_id and the counts that a reader of a report sees first: all differences, by status, and unmatched clauses."""
    return reports.select(PAIR, F.expr("n_modified + n_added + n_deleted").alias("n_total"), "n_modified", "n_added", "n_deleted", F.expr("n_added + n_deleted").alias("n_unmatched"))


def raw_compare(texts: DataFrame, config: CompareConfig | None = None, unicode: bool = True) -> tuple[DataFrame, DataFrame]:
    """Hunks and line statistics of texts (pair_id, side, text)."""
    config = config or CompareConfig()
    lines = D.to_lines(texts, [PAIR, "side"], unicode=unicode)
    found = D.anchors(lines)
    hunks = D.hunks(D.gap_table(lines, found), config.char_level)
    return D.with_context(hunks, lines, config.context_lines), D.line_statistics(hunks, found, lines)


def gated_raw_compare(texts: DataFrame, diagnostics: DataFrame, config: CompareConfig | None = None, unicode: bool = True) -> tuple[DataFrame, DataFrame]:
    """As ``raw_compare``; the statistics of a pair also say whether its pages were read reliably, and which were not (counted from 1)."""
    hunks, statistics = raw_compare(texts, config, unicode)
    gated = R.gate_report(statistics.withColumn("overall_risk", F.lit("")), diagnostics).drop("overall_risk")
    return hunks, gated.withColumn("similarity_percent", F.round(100 * F.col("similarity"), 2))
