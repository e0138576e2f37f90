"""Line diff of two texts: anchors by SQL, opcodes only inside the gaps between them.

Lines that occur once on each side and are equal anchor the two texts, as far
as they go forward on both. A gap with one empty side needs no matcher; the
others run in parallel, so one long document does not hold up the rest.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from redline.functions.kernels import bag_and_norm, bag_dot, bag_norm, opcodes, segments
from redline.functions.text import lines as split_lines, normalize_text
from redline.lineage import materialized
from redline.operators.align import pairs_of, whole_pairs

PAIR = "pair_id"
#: Rows that a task collects before it gives them on.
MADE = 10_000
HUNK = f"{PAIR} long, gap int, op_ord int, tag string, word_from int, word_lines array<string>, pdf_from int, pdf_lines array<string>, char_segments array<struct<op: string, text: string>>"


def to_lines(texts: DataFrame, keys: list[str], text: str = "text", unicode: bool = True) -> DataFrame:
    """keys, line_ord (from 0) and line of normalised texts."""
    norm = texts.select(*keys, normalize_text(F.col(text), unicode).alias("n"))
    return norm.select(*keys, F.posexplode(split_lines(F.col("n"))).alias("line_ord", "line"))


def anchors(lines: DataFrame) -> DataFrame:
    """pair_id, word_ord, pdf_ord, anchor (from 1) of equal lines that are unique on both sides and run forward.

    A line whose pdf place is not beyond every earlier kept one is skipped; a
    running maximum is the same, since a skipped place is never the largest.
    """
    once = lines.withColumn("n", F.count("*").over(Window.partitionBy(PAIR, "side", "line"))).where("n = 1")
    word = once.where("side = 'word'").select(PAIR, "line", F.col("line_ord").alias("word_ord"))
    pdf = once.where("side = 'pdf'").select(PAIR, "line", F.col("line_ord").alias("pdf_ord"))
    both = word.join(pdf, [PAIR, "line"])
    order = Window.partitionBy(PAIR).orderBy("word_ord")
    before = F.max("pdf_ord").over(order.rowsBetween(Window.unboundedPreceding, -1))
    kept = both.withColumn("before", before).where(F.col("before").isNull() | (F.col("pdf_ord") > F.col("before")))
    return kept.select(PAIR, "word_ord", "pdf_ord", F.row_number().over(order).alias("anchor"))


def gaps(lines: DataFrame, found: DataFrame) -> DataFrame:
    """Each line that is no anchor with ``gap``: the number of anchors before it on its side."""
    out = None
    for side in ("word", "pdf"):
        marks = found.select(PAIR, F.col(f"{side}_ord").alias("line_ord"), F.lit(1).alias("is_anchor"))
        mine = lines.where(F.col("side") == side).join(marks, [PAIR, "line_ord"], "left")
        order = Window.partitionBy(PAIR).orderBy("line_ord").rowsBetween(Window.unboundedPreceding, 0)
        mine = mine.withColumn("gap", F.coalesce(F.sum("is_anchor").over(order), F.lit(0)).cast("int")).where("is_anchor is null")
        mine = mine.select(PAIR, "side", "gap", "line_ord", "line")
        out = mine if out is None else out.unionByName(mine)
    return out


def gap_table(lines: DataFrame, found: DataFrame) -> DataFrame:
    """One row for each gap that has lines: its lines on both sides, where they start, and kind (insert, delete or both)."""
    side = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("line_ord", "line"))))
    rows = gaps(lines, found).groupBy(PAIR, "gap").agg(side("word").alias("w"), side("pdf").alias("p"))
    kind = F.when(F.size("w") == 0, "insert").when(F.size("p") == 0, "delete").otherwise("both")
    texts = lambda c: F.transform(c, lambda x: x["line"])
    return rows.select(PAIR, "gap", kind.alias("kind"), F.get("w", F.lit(0))["line_ord"].alias("word_from"), texts("w").alias("word_lines"),
                       F.get("p", F.lit(0))["line_ord"].alias("pdf_from"), texts("p").alias("pdf_lines"))


#: Documents that may meet by one line; four times as many at each further level.
OFTEN = 100


def most_shared(sets: DataFrame) -> DataFrame:
    """doc, base and n: of all lesser documents the one with which each has most items in common (n, two at least; ties to the least).

    ``sets``: doc (unique) and set, a sorted array without repeats. All
    documents count, and all items; yet common items make no pairs of all that
    have them. Documents of one set are a class, for which its least stands:
    the others have its base if that has the whole set, and else the least
    itself. Of these, those that share an item of few meet by it and count all
    that they share. What others share are commoner items alone: the same
    question, of the sets of those items, which fall into fewer classes; so it
    is asked again, with a higher limit each time, until no item is commoner.
    """
    best = lambda df: df.groupBy("doc").agg(F.max(F.struct("n", (-F.col("base")).alias("back"))).alias("x")).select("doc", (-F.col("x.back")).alias("base"), "x.n")
    levels, limit = [], 1
    while True:
        same = Window.partitionBy(F.xxhash64("set"), F.xxhash64(F.lit(7), "set"))
        classed = sets.where("size(set) > 1").withColumn("least", F.min("doc").over(same))
        level = materialized(classed.select("doc", "least", F.size("set").alias("size"), F.when(F.col("doc") == F.col("least"), F.col("set")).alias("set")))
        if not level.take(1):
            break
        items = level.where("set is not null").select("doc", F.explode("set").alias("item")).withColumn("often", F.count("*").over(Window.partitionBy("item")))
        sets = items.where(F.col("often") > limit).groupBy("doc").agg(F.sort_array(F.collect_list("item")).alias("set"))
        found = None
        if limit > 1:
            few = items.where(F.col("often").between(2, limit)).select("doc", "item")
            met = few.join(few.select(F.col("doc").alias("base"), "item"), "item").where("base < doc").groupBy("doc", "base").agg(F.count("*").alias("rare"))
            met = met.join(sets.select("doc", F.col("set").alias("s")), "doc", "left").join(sets.select(F.col("doc").alias("base"), F.col("set").alias("t")), "base", "left")
            more = F.when(F.col("s").isNotNull() & F.col("t").isNotNull(), F.size(F.array_intersect("s", "t"))).otherwise(0)
            found = best(met.select("doc", "base", (F.col("rare") + more).alias("n")).where("n > 1"))
        levels.append((level, found))
        limit = OFTEN if limit == 1 else 4 * limit
    out = level.select("doc", F.col("least").alias("base"), F.col("size").cast("long").alias("n"))  # of no row
    for level, found in reversed(levels):
        of = best(out if found is None else out.unionByName(found)).withColumnsRenamed({"doc": "least", "n": "most"})
        copy = F.col("doc") != F.col("least")
        base = F.when(copy & (F.coalesce("most", F.lit(0)) < F.col("size")), F.col("least")).otherwise(F.col("base"))
        out = level.join(of, "least", "left").select("doc", base.alias("base"), F.when(copy, F.col("size")).otherwise(F.col("most")).cast("long").alias("n")).where("base is not null")
    return out


def line_marks(text) -> list:
    """Columns a and b: two 64-bit hashes of each line of the normalised text, which stand for the line where only equality counts."""
    found = split_lines(normalize_text(text, False))
    return [F.transform(found, lambda x: F.xxhash64(x)).alias("a"), F.transform(found, lambda x: F.xxhash64(F.lit(7), x)).alias("b")]


def _anchors(word: list[tuple], pdf: list[tuple]) -> list[tuple[int, int]]:
    """``anchors`` of one pair, given as two lists of (ordinal, line) in order."""
    w, p = (Counter(line for _, line in side) for side in (word, pdf))
    place = {line: n for n, line in pdf if p[line] == 1}
    kept, last = [], -1
    for n, line in word:
        if w[line] == 1 and place.get(line, -1) > last:
            last = place[line]
            kept.append((n, last))
    return kept


def _gaps(word: list[tuple], pdf: list[tuple]) -> list[tuple[int, list[tuple], list[tuple]]]:
    """gap and its (ordinal, line) on both sides: ``gaps`` of one pair."""
    kept, found = _anchors(word, pdf), {}
    for i, side in enumerate((word, pdf)):
        marks, gap = [k[i] for k in kept], 0
        for n, line in side:
            while gap < len(marks) and marks[gap] < n:
                gap += 1
            if gap == len(marks) or marks[gap] != n:
                found.setdefault(gap, ([], []))[i].append((n, line))
    return [(gap, *sides) for gap, sides in sorted(found.items())]


def _kind(word, pdf) -> str:
    return "insert" if not word else "both" if pdf else "delete"


def in_pairs(sides: DataFrame, columns: list[str], schema: str, kernel: Callable[[list[tuple], list[tuple]], list[tuple]]) -> DataFrame:
    """pair_id and the columns of ``schema`` that ``kernel`` makes of a pair's rows (tuples of ``columns``) of the word and of the pdf side.

    Both sides of a pair meet in one task, once; nothing of a text is dealt out by itself.
    """
    rows = sides.select(PAIR, "side", *columns).where("side in ('word', 'pdf')")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(PAIR).orderBy("side")))  # brings pairs together
    out = StructType([rows.schema[PAIR], *_parse_datatype_string(schema).fields])

    def run(batches):
        for table in whole_pairs(batches):
            key, side, *values = (table.column(c).chunk(0) for c in (PAIR, "side", *columns))
            cuts = np.flatnonzero(np.diff(pairs_of(key), prepend=-1)).tolist()
            pairs, names, made = key.to_pylist(), side.to_pylist(), []
            for start, end in zip(cuts, [*cuts[1:], len(pairs)], strict=True):
                both: dict[str, list[tuple]] = {"word": [], "pdf": []}
                for i in range(start, end):
                    both[names[i]].append(tuple(v[i].as_py() for v in values))
                made += [(pairs[start], *x) for x in kernel(both["word"], both["pdf"])]
                if len(made) >= MADE:
                    yield _batch(made, out)
                    made = []
            if made:
                yield _batch(made, out)

    return rows.mapInArrow(run, out)


def _batch(rows: list[tuple], schema: StructType) -> pa.RecordBatch:
    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)


def _numbered(rows: list[tuple]) -> list[tuple]:
    """(ordinal, line) of the lists of lines, or of both marks of lines, that the rows of one side have."""
    lines = [x for row in rows for x in enumerate(row[0] if len(row) == 1 else zip(*row, strict=True))]
    return lines if len(rows) == 1 else sorted(lines)


MARKS = ["a", "b"]


def gap_sizes(marks: DataFrame) -> DataFrame:
    """pair_id, gap, kind, n_word and n_pdf of ``gap_table``, where only the numbers of lines are wanted.

    ``marks``: pair_id, side, and a and b (see ``line_marks``).
    """

    def kernel(word, pdf):
        return [(gap, _kind(w, p), len(w), len(p)) for gap, w, p in _gaps(_numbered(word), _numbered(pdf))]

    return in_pairs(marks, MARKS, "gap int, kind string, n_word long, n_pdf long", kernel)


def paired_bags(sides: DataFrame) -> DataFrame:
    """pair_id and sim: the cosine of term counts of a pair's two texts (column text), where they have a term in common."""

    def kernel(word, pdf):
        if len(word) == len(pdf) == 1:
            (x, a), (y, b) = (bag_and_norm(side[0][0] or "") for side in (word, pdf))
        else:
            x, y = (dict(sum((Counter(bag_and_norm(t or "")[0]) for (t,) in side), Counter())) for side in (word, pdf))
            a, b = bag_norm(x), bag_norm(y)
        dot = bag_dot(x, y)
        return [(dot / (a * b),)] if dot else []

    return in_pairs(sides, ["text"], "sim double", kernel)


def paired_similarity(marks: DataFrame) -> DataFrame:
    """``multiset_similarity`` of the marks of lines (see ``line_marks``)."""

    def kernel(word, pdf):
        w, p = (Counter(line for _, line in _numbered(side)) for side in (word, pdf))
        total = w.total() + p.total()
        return [((w & p).total(), total)] if total else []

    found = in_pairs(marks, MARKS, "common long, total long", kernel)
    return found.withColumn("similarity", F.round(2 * F.col("common") / F.col("total"), 4))


LINES = ["lines"]


def whole_lines(text) -> list:
    """Column lines: the lines of the normalised text."""
    return [split_lines(normalize_text(text, False)).alias("lines")]


def paired_hunks(sides: DataFrame, char_level: bool = True, context: int = 1) -> DataFrame:
    """``with_context`` of the hunks of the lines of both sides (see ``whole_lines``), without the places of their lines."""

    def kernel(word, pdf):
        word, pdf = _numbered(word), _numbered(pdf)
        whole, out = [x for _, x in word], []
        for gap, w, p in _gaps(word, pdf):
            start = w[0][0] if w else gap
            w, p = [x for _, x in w], [x for _, x in p]
            for tag, a, b, c, d in opcodes(w, p) if w and p else [(_kind(w, p), 0, len(w), 0, len(p))]:
                if tag != "equal":
                    fine = segments(w[a], p[c]) if char_level and tag == "replace" and b - a == d - c == 1 else []
                    out.append((len(out), gap, tag, w[a:b], p[c:d], whole[max(start + a - context, 0) : start + a], whole[start + b : start + b + context], fine))
        return out

    text = "array<string>"
    schema = f"hunk_ord int, gap int, tag string, word_lines {text}, pdf_lines {text}, context_before {text}, context_after {text}, char_segments array<struct<op: string, text: string>>"
    return in_pairs(sides, LINES, schema, kernel)


def paired_gap_table(sides: DataFrame, kinds: tuple[str, ...] = ("insert", "delete", "both")) -> DataFrame:
    """``gap_table`` of the lines of both sides (see ``whole_lines``), of these kinds."""
    texts = lambda side: [x for _, x in side]
    start = lambda side: side[0][0] if side else None

    def kernel(word, pdf):
        found = ((gap, _kind(w, p), w, p) for gap, w, p in _gaps(_numbered(word), _numbered(pdf)))
        return [(gap, kind, start(w), texts(w), start(p), texts(p)) for gap, kind, w, p in found if kind in kinds]

    return in_pairs(sides, LINES, "gap int, kind string, word_from int, word_lines array<string>, pdf_from int, pdf_lines array<string>", kernel)


def paired_anchors(marks: DataFrame) -> DataFrame:
    """``anchors`` of the marks of lines (see ``line_marks``)."""

    def kernel(word, pdf):
        return [(w, p, n) for n, (w, p) in enumerate(_anchors(_numbered(word), _numbered(pdf)), 1)]

    return in_pairs(marks, MARKS, "word_ord int, pdf_ord int, anchor int", kernel)


def paired_statistics(marks: DataFrame) -> DataFrame:
    """``line_statistics`` of the marks of lines (see ``line_marks``)."""

    def kernel(word, pdf):
        word, pdf = _numbered(word), _numbered(pdf)
        n = Counter(equal=len(_anchors(word, pdf)))
        for _, w, p in _gaps(word, pdf):
            for tag, a, b, c, d in opcodes([x for _, x in w], [x for _, x in p]) if w and p else [(_kind(w, p), 0, len(w), 0, len(p))]:
                n[tag] += max(b - a, d - c)
        return [(len(word), len(pdf), *(n[tag] for tag in ("equal", "replace", "delete", "insert")))] if word or pdf else []

    found = in_pairs(marks, MARKS, "word_lines long, pdf_lines long, equal_lines long, replaced_lines long, deleted_lines long, inserted_lines long", kernel)
    return found.withColumn("similarity", F.round(2 * F.col("equal_lines") / (F.col("word_lines") + F.col("pdf_lines")), 4))


def hunks(table: DataFrame, char_level: bool = True) -> DataFrame:
    """The hunks of all gaps, and rows tagged ``equal`` for lines that a matcher pairs inside a gap."""
    none = F.array().cast("array<struct<op: string, text: string>>")
    trivial = table.where("kind <> 'both'").select(
        PAIR, "gap", F.lit(0).alias("op_ord"), F.col("kind").alias("tag"), "word_from", "word_lines", "pdf_from", "pdf_lines", none.alias("char_segments")
    )

    def run(batches):
        for pdf in batches:
            out = []
            for pair, gap, w0, ws, p0, ps in zip(*(pdf[c] for c in (PAIR, "gap", "word_from", "word_lines", "pdf_from", "pdf_lines")), strict=True):
                ws, ps = list(ws), list(ps)
                for n, (tag, a, b, c, d) in enumerate(opcodes(ws, ps)):
                    fine = segments(ws[a], ps[c]) if char_level and tag == "replace" and b - a == d - c == 1 else []
                    out.append((pair, gap, n, tag, w0 + a, ws[a:b], p0 + c, ps[c:d], fine))
            yield pd.DataFrame(out, columns=[PAIR, "gap", "op_ord", "tag", "word_from", "word_lines", "pdf_from", "pdf_lines", "char_segments"])

    matched = table.where("kind = 'both'").mapInPandas(run, HUNK)
    return trivial.unionByName(matched)


def with_context(found: DataFrame, lines: DataFrame, context: int = 1, compat: bool = False) -> DataFrame:
    """Hunks (without equal rows) in order, with the word lines just before and after.

    ``compat`` gives the shape that the replaced program had with one context
    line: nothing before, and for a pure insertion one line too far after.
    """
    texts = lines.where("side = 'word'").groupBy(PAIR).agg(F.transform(F.array_sort(F.collect_list(F.struct("line_ord", "line"))), lambda x: x["line"]).alias("all"))
    order = Window.partitionBy(PAIR).orderBy("gap", "op_ord")
    rows = found.where("tag <> 'equal'").withColumn("hunk_ord", F.row_number().over(order) - 1).join(texts, PAIR, "left")
    start = F.coalesce(F.col("word_from"), F.col("gap"))
    end = start + F.size("word_lines")
    whole = F.coalesce("all", F.array().cast("array<string>"))
    cut = lambda a, b: F.slice(whole, F.greatest(a, F.lit(0)) + 1, F.greatest(F.least(b, F.size(whole)) - F.greatest(a, F.lit(0)), F.lit(0)))
    skip = F.when(F.size("word_lines") == 0, 1).otherwise(0) if compat else F.lit(0)
    before = F.array().cast("array<string>") if compat else cut(start - context, start)
    return rows.withColumn("context_before", before).withColumn("context_after", cut(end + skip, end + skip + context)).drop("all")


def line_statistics(found: DataFrame, anchor_rows: DataFrame, lines: DataFrame) -> DataFrame:
    """equal, replaced (the longer side), deleted and inserted lines, totals and similarity of each pair."""
    w, p = F.size("word_lines"), F.size("pdf_lines")
    of = lambda tag, n: F.sum(F.when(F.col("tag") == tag, n).otherwise(0)).alias(f"n_{tag}")
    inner = found.groupBy(PAIR).agg(of("equal", w), of("replace", F.greatest(w, p)), of("delete", w), of("insert", p))
    outer = anchor_rows.groupBy(PAIR).agg(F.count("*").alias("n_anchor"))
    total = lines.groupBy(PAIR).agg(F.count_if(F.col("side") == "word").alias("word_lines"), F.count_if(F.col("side") == "pdf").alias("pdf_lines"))
    joined = total.join(inner, PAIR, "left").join(outer, PAIR, "left").fillna(0)
    equal = F.col("n_equal") + F.col("n_anchor")
    ratio = F.round(2 * equal / (F.col("word_lines") + F.col("pdf_lines")), 4)
    return joined.select(PAIR, "word_lines", "pdf_lines", equal.alias("equal_lines"), F.col("n_replace").alias("replaced_lines"),
                         F.col("n_delete").alias("deleted_lines"), F.col("n_insert").alias("inserted_lines"), ratio.alias("similarity"))


def multiset_similarity(lines: DataFrame) -> DataFrame:
    """2 * common / total lines, where common counts equal lines as often as both sides have them, in any order."""
    n = lines.groupBy(PAIR, "line").agg(F.count_if(F.col("side") == "word").alias("a"), F.count_if(F.col("side") == "pdf").alias("b"))
    sums = n.groupBy(PAIR).agg(F.sum(F.least("a", "b")).alias("common"), F.sum(F.col("a") + F.col("b")).alias("total"))
    return sums.select(PAIR, "common", "total", F.round(2 * F.col("common") / F.col("total"), 4).alias("similarity"))
