"""Alignment of the clauses of two sides: by number, by field, by similarity, and what is left."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from redline.functions.geometry import cosine
from redline.functions.kernels import BLANKS, bag_and_norm, bag_dot, bag_similarity, normal_text
from redline.functions.text import bag_terms
from redline.functions.values import KINDS as VALUES, changes

PAIR = "pair_id"


def _paired(word: DataFrame, pdf: DataFrame, keys: list[str], first: str, match: str) -> DataFrame:
    """The k-th of one side with the k-th of the other within equal keys; ``grp`` orders keys by first appearance on side ``first``."""
    def numbered(df: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy(PAIR, *keys)
        return df.select(PAIR, *keys, F.col("clause_ord").alias(f"{name}_clause_ord"), F.row_number().over(w.orderBy("clause_ord")).alias("occ"),
                         F.min("clause_ord").over(w).alias(f"{name}_first"))

    both = numbered(word, "word").join(numbered(pdf, "pdf"), [PAIR, *keys, "occ"])
    return both.select(PAIR, "word_clause_ord", "pdf_clause_ord", F.lit(match).alias("match_type"), F.lit(1.0).alias("similarity"),
                       F.col(f"{first}_first").alias("grp"), "occ")


def by_number(word: DataFrame, pdf: DataFrame) -> DataFrame:
    return _paired(word.where("number <> ''"), pdf.where("number <> ''"), ["number", "level"], "pdf", "number")


def leftovers(side: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """The clauses of a side that no pair has taken."""
    used = pairs.select(PAIR, F.col(f"{name}_clause_ord").alias("clause_ord"))
    return side.join(used, [PAIR, "clause_ord"], "left_anti")


def by_field(word: DataFrame, pdf: DataFrame) -> DataFrame:
    return _paired(word.where("field_key <> ''"), pdf.where("field_key <> ''"), ["field_key"], "word", "field")


def positions(left: DataFrame) -> DataFrame:
    """``pos``: the place among a side's leftovers, from 0."""
    return left.withColumn("pos", F.row_number().over(Window.partitionBy(PAIR).orderBy("clause_ord")) - 1)


def bag_similarities(word: DataFrame, pdf: DataFrame) -> DataFrame:
    """pair_id, pi, wi, sim of leftovers that have a term in common: cosine of term counts.

    Terms join within a pair, so no pair of clauses without a common term is
    made; those count as 0 wherever they are needed.
    """
    def counted(df: DataFrame, name: str) -> DataFrame:
        terms = df.select(PAIR, F.col("pos").alias(name), F.explode(bag_terms(F.col("text"))).alias("term"))
        counts = terms.groupBy(PAIR, name, "term").agg(F.count("*").alias(f"n_{name}"))
        norm = F.sqrt(F.sum(F.col(f"n_{name}") * F.col(f"n_{name}")).over(Window.partitionBy(PAIR, name)))
        return counts.withColumn(f"norm_{name}", norm)

    both = counted(word, "wi").join(counted(pdf, "pi"), [PAIR, "term"])
    dot = both.groupBy(PAIR, "pi", "wi").agg(F.sum(F.col("n_wi") * F.col("n_pi")).alias("dot"), F.first("norm_wi").alias("a"), F.first("norm_pi").alias("b"))
    return dot.select(PAIR, "pi", "wi", (F.col("dot") / (F.col("a") * F.col("b"))).alias("sim"))


def window_similarities(word: DataFrame, pdf: DataFrame, reach: int = 5, vector: str = "embedding") -> DataFrame:
    """pair_id, pi, wi, sim of the positions within ``reach`` of one another: each pdf position meets 2 * reach + 1 places by an equi-join."""
    a = word.select(PAIR, F.col("pos").alias("wi"), F.col(vector).alias("x"))
    near = F.explode(F.sequence(F.greatest(F.col("pos") - reach, F.lit(0)), F.col("pos") + reach))
    b = pdf.select(PAIR, F.col("pos").alias("pi"), F.col(vector).alias("y"), near.alias("wi"))
    return a.join(b, [PAIR, "wi"]).select(PAIR, "pi", "wi", cosine(F.col("x"), F.col("y")).alias("sim"))


def _unit(vectors: pd.Series) -> np.ndarray:
    """Rows of length 1, or 0 where a vector is empty or nothing; shorter ones are filled with 0."""
    rows = [np.zeros(0) if v is None else np.asarray(v, float) for v in vectors]
    out = np.zeros((len(rows), max((len(r) for r in rows), default=0)))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def _cogrouped(word: DataFrame, pdf: DataFrame, vector: str, find) -> DataFrame:
    """``find`` (unit vectors of both sides in order of position -> rows pi, wi, sim) for each pair: vectors travel, not pairs of them."""
    def run(key: tuple, w: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        ordered = [df.sort_values(df.columns[1]).iloc[:, 2] if len(df) else pd.Series([], dtype=object) for df in (w, p)]
        both = _unit(pd.concat(ordered))
        made = find(both[: len(w)], both[len(w) :]) if len(p) else []
        return pd.DataFrame({PAIR: [key[0]] * len(made), "pi": [m[0] for m in made], "wi": pd.array([m[1] for m in made], "Int32"), "sim": [m[2] for m in made]})

    def take(df: DataFrame, side: str):
        """Columns of its own for each side: both may come from one frame."""
        return df.select(F.col(PAIR).alias(f"{side}_pair"), F.col("pos").alias(f"{side}_pos"), F.col(vector).alias(f"{side}_vector")).groupBy(f"{side}_pair")

    return take(word, "w").cogroup(take(pdf, "p")).applyInPandas(run, f"{PAIR} long, pi int, wi int, sim double")


def best_dense(word: DataFrame, pdf: DataFrame, vector: str = "embedding") -> DataFrame:
    """The best word position of all for each pdf position of pairs with both sides (to 6 places; ties to the lowest), block by block within a pair."""
    def find(w: np.ndarray, p: np.ndarray) -> list[tuple[int, int, float]]:
        out = []
        for at in range(0, len(p) if len(w) else 0, 256):
            sims = p[at : at + 256] @ w.T
            best = np.round(sims, 6).argmax(1)
            out += [(at + i, int(b), float(sims[i, b])) for i, b in enumerate(best)]
        return out

    return _cogrouped(word, pdf, vector, find)


def greedy_dense(word: DataFrame, pdf: DataFrame, threshold: float, reach: int = 5, vector: str = "embedding") -> DataFrame:
    """As ``greedy`` over vectors: a pdf position looks at its window, and at all word positions only where that fails."""
    def find(w: np.ndarray, p: np.ndarray) -> list[tuple[int, int | None, float]]:
        free, out = np.ones(len(w), bool), []
        for i in range(len(p)):
            lo, hi = max(0, i - reach), min(len(w), i + reach + 1)
            found, best = None, -1.0
            if lo < hi and free[lo:hi].any():
                near = np.where(free[lo:hi], w[lo:hi] @ p[i], -1.0)
                found, best = lo + int(near.argmax()), float(near.max())
            if (found is None or best < threshold) and free.any():
                row = np.where(free, w @ p[i], -1.0)
                if row.max() > best:
                    found, best = int(row.argmax()), float(row.max())
            if found is not None and best >= threshold:
                free[found] = False
            else:
                found, best = None, max(best, 0.0)
            out.append((i, found, best))
        return out

    return _cogrouped(word, pdf, vector, find)


def best_in_window(sims: DataFrame, reach: int = 5) -> DataFrame:
    """The best word position within ``reach`` of each pdf position, before any is consumed; ties to the lowest."""
    return sims.where(F.abs(F.col("wi") - F.col("pi")) <= reach).groupBy(PAIR, "pi").agg(
        F.max_by("wi", F.struct("sim", -F.col("wi"))).alias("wi"), F.max("sim").alias("sim")
    )


def assign(pi: np.ndarray, wi: np.ndarray, sim: np.ndarray, n_pdf: int, n_word: int, threshold: float, reach: int) -> list[tuple[int, int | None, float]]:
    """Pdf positions in order, each with the word position it takes (or None) and the similarity.

    The best free one in the window is taken if it reaches the threshold;
    otherwise the best free one anywhere, if it is strictly better.
    """
    free, out = np.ones(n_word, bool), []
    order = np.lexsort((wi, pi))
    pi, wi, sim = pi[order], wi[order], sim[order]
    cuts = np.searchsorted(pi, np.arange(n_pdf + 1))
    for p in range(n_pdf):
        row = np.zeros(n_word)
        row[wi[cuts[p] : cuts[p + 1]]] = sim[cuts[p] : cuts[p + 1]]
        row[~free] = -1.0
        lo, hi = max(0, p - reach), min(n_word, p + reach + 1)
        w, best = None, -1.0
        if lo < hi and free[lo:hi].any():
            w = lo + int(row[lo:hi].argmax())
            best = float(row[w])
        if w is None or best < threshold:
            g = int(row.argmax()) if free.any() else None
            if g is not None and row[g] > best:
                w, best = g, float(row[g])
        if w is not None and best >= threshold:
            free[w] = False
            out.append((p, w, best))
        else:
            out.append((p, None, max(best, 0.0)))
    return out


def greedy(sims: DataFrame, sizes: DataFrame, threshold: float, reach: int = 5) -> DataFrame:
    """pair_id, pi, wi (null: unmatched), sim by ``assign`` within each pair.

    ``sizes`` has n_pdf and n_word for each pair. The order of consumption is
    sequential within a pair; pairs run in parallel.
    """
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n, found = rows.iloc[0], rows[rows["pi"].notna()]
        made = assign(found["pi"].to_numpy(int), found["wi"].to_numpy(int), found["sim"].to_numpy(float), int(n["n_pdf"]), int(n["n_word"]), threshold, reach)
        return pd.DataFrame({PAIR: [key[0]] * len(made), "pi": [m[0] for m in made], "wi": pd.array([m[1] for m in made], "Int32"), "sim": [m[2] for m in made]})

    rows = sizes.join(sims, PAIR, "left").select(PAIR, "n_pdf", "n_word", "pi", "wi", "sim")
    return rows.groupBy(PAIR).applyInPandas(run, f"{PAIR} long, pi int, wi int, sim double")


#: What ``matched`` says of an alignment, besides the columns of its two sides.
ALIGNMENT = ["align_idx", "word_clause_ord", "pdf_clause_ord", "match_type", "similarity"]
_blank = re.compile(f"[{BLANKS}]+")
#: Pairs of leftovers up to which each text's bag meets each other's by itself.
FEW = 16
KINDS, STATUS, RISK = ["number", "field", "semantic", "unmatched"], ["identical", "modified", "added", "deleted"], ["none", "low", "medium", "high"]


def whole_pairs(batches: Iterator[pa.RecordBatch], rows: int = 1, size: int = 0) -> Iterator[pa.Table]:
    """Batches of rows in order of their first column, cut so that no pair is parted; a table has ``rows`` rows or ``size`` bytes, or what is left."""
    held: list[pa.RecordBatch] = []
    done: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        code = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
        cut = int(np.append(0, np.flatnonzero(code[1:] != code[:-1]) + 1)[-1])
        if cut or (held and held[0].column(0)[0].as_py() != batch.column(0)[cut].as_py()):
            done += [*held, *([batch.slice(0, cut)] if cut else [])]
            held = []
            if done and (sum(x.num_rows for x in done) >= rows or sum(x.nbytes for x in done) >= size):
                yield pa.Table.from_batches(done).combine_chunks()
                done = []
        held.append(batch.slice(cut))
    if done or held:
        yield pa.Table.from_batches([*done, *held]).combine_chunks()


def _nearest(word: list[str | None], pdf: list[str | None], threshold: float, reach: int) -> list[tuple[int | None, float]]:
    """The word position that each pdf position takes (or None) and the similarity: ``assign`` over the cosines of bags.

    Texts meet by their terms, so none without a common term does; those are 0.
    """
    (bags, norms), (others, wholes) = (tuple(zip(*[bag_and_norm(t or "") for t in side], strict=True)) or ((), ()) for side in (word, pdf))
    if len(bags) == len(others) == 1 and threshold > 0 <= reach:
        value = d / (norms[0] * wholes[0]) if (d := bag_dot(bags[0], others[0])) else 0.0
        return [(0 if value >= threshold else None, value)]
    if len(bags) * len(others) <= FEW:  # no index pays
        near = [{w: d for w, x in enumerate(bags) if (d := bag_dot(x, b))} for b in others]
    else:
        near, index = [], defaultdict(list)
        for w, b in enumerate(bags):
            for term, n in b.items():
                index[term].append((w, n))
        for b in others:
            dots = defaultdict(int)
            for term, n in b.items():
                for w, m in index.get(term, ()):
                    dots[w] += n * m
            near.append(dots)
    rows = [{w: d / (norms[w] * whole) for w, d in dots.items()} for dots, whole in zip(near, wholes, strict=True)]
    if threshold <= 0:  # then a similarity of 0 takes a place, too
        at = [(p, w, s) for p, row in enumerate(rows) for w, s in row.items()]
        pi, wi, sim = (np.array([x[i] for x in at], kind) for i, kind in enumerate((int, int, float)))
        return [(w, s) for _, w, s in assign(pi, wi, sim, len(pdf), len(word), threshold, reach)]
    taken, out = set(), []
    for p, row in enumerate(rows):
        free = [(s, -w) for w, s in row.items() if w not in taken]
        best, place = max((x for x in free if abs(-x[1] - p) <= reach), default=(0.0, None))
        if best < threshold and free and max(free)[0] > best:
            best, place = max(free)
        if place is not None and best >= threshold:
            taken.add(-place)
            out.append((-place, best))
        else:
            out.append((None, best))
    return out


def _by_key(pair: np.ndarray, word: np.ndarray, number: pa.Array, level: pa.Array, first: str) -> tuple[np.ndarray, np.ndarray]:
    """(word row, pdf row) of all pairs of a table by a key (null or blank: none) and level: the k-th with the k-th, keys in order of their first row of side ``first``."""
    coded = number.dictionary_encode()
    blank = coded.dictionary.index("").as_py()
    code = pc.fill_null(coded.indices, -1).to_numpy()
    rows = np.flatnonzero((code >= 0) & (code != blank) & level.is_valid().to_numpy(zero_copy_only=False))
    depth = pc.fill_null(level, 0).to_numpy()
    if not len(rows):
        return rows, rows
    rows = rows[np.lexsort((word[rows], depth[rows], code[rows], pair[rows]))]  # stable: rows of a key and side stay in order of ordinal
    key = [x[rows] for x in (pair, code, depth)]
    start = np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in key], axis=0)))
    n_word = np.add.reduceat(word[rows].astype(np.int64), start)
    n_pdf = np.diff(np.append(start, len(rows))) - n_word
    both = np.minimum(n_word, n_pdf)
    of = np.repeat(np.arange(len(start)), both)
    k = np.arange(len(of)) - np.repeat(np.cumsum(both) - both, both)
    order = np.lexsort((k, rows[start[of] + (n_pdf[of] if first == "word" else 0)]))
    return rows[start[of] + n_pdf[of] + k][order], rows[start[of] + k][order]


def _left(word: list[int], pdf: list[int], text: dict[int, str | None], threshold: float, reach: int) -> list[tuple]:
    """(word row, pdf row, match_type, similarity) of what numbers and fields leave on both sides of one pair, in order; rows of a side come in order of ordinal, None is no row."""
    found = _nearest([text[i] for i in word], [text[i] for i in pdf], threshold, reach)
    out = [(None, p, "unmatched", s) if w is None else (word[w], p, "semantic", s) for p, (w, s) in zip(pdf, found, strict=True)]
    gone = {w for w, _ in found}
    return out + [(i, None, "unmatched", 0.0) for w, i in enumerate(word) if w not in gone]


def _covered(w: np.ndarray, p: np.ndarray, pair: np.ndarray, word: np.ndarray, order: np.ndarray, text: pa.Array, least: int) -> np.ndarray:
    """Is an alignment (rows w and p, -1 is none) a fragment that the partner of a paired neighbour (ordinal distance 1 on its side) contains?"""
    hit = np.zeros(len(w), bool)
    partner = np.full(len(pair), -1)
    both = (w >= 0) & (p >= 0)
    partner[w[both]], partner[p[both]] = p[both], w[both]
    alone = np.flatnonzero(~both)
    row = np.maximum(w[alone], p[alone])
    side = pair * 2 + word
    asked: list[tuple[np.ndarray, np.ndarray]] = []
    for step in (-1, 1):
        near = row + step
        # Ordinals can repeat: the neighbour is then behind the rows of the same one, and its last row counts.
        for _ in range(len(pair)):
            at = np.clip(near, 0, len(pair) - 1)
            same = (near == at) & (side[at] == side[row]) & (order[at] == order[row])
            if not same.any():
                break
            near = np.where(same, near + step, near)
        for _ in range(len(pair) if step > 0 else 0):
            at, then = np.clip(near, 0, len(pair) - 1), np.clip(near + 1, 0, len(pair) - 1)
            more = (near + 1 == then) & (near == at) & (side[then] == side[at]) & (order[then] == order[at])
            if not more.any():
                break
            near = np.where(more, near + 1, near)
        at = np.clip(near, 0, len(pair) - 1)
        fits = np.flatnonzero((near == at) & (side[at] == side[row]) & (order[at] == order[row] + step) & (partner[at] >= 0))
        asked.append((alone[fits], partner[at[fits]]))
    which, other = (np.concatenate(x) for x in zip(*asked, strict=True))
    blanks = pc.any(pc.match_substring_regex(text.take(pa.array(np.concatenate([np.maximum(w, p)[which], other]))), _blank.pattern)).as_py()
    compact = lambda rows: [_blank.sub("", t or "") if blanks else t or "" for t in listed(text.take(pa.array(rows)))]
    for i, c, whole in zip(which.tolist(), compact(np.maximum(w, p)[which]), compact(other), strict=True):
        hit[i] |= len(c) >= least and c in whole
    return hit


#: Texts of ASCII without blanks and of common Chinese characters alone are normal as they are.
_unplain = r"[^\x21-\x7e\x{4e00}-\x{9fff}]"


def tidied(texts: pa.Array, make) -> pa.Array:
    """``make`` of each text (null: ''); of texts that are plain it would be the text itself, so they never become Python values."""
    texts = pc.fill_null(texts, "")
    odd = pc.match_substring_regex(texts, _unplain)
    if not pc.any(odd).as_py():
        return texts
    return pc.replace_with_mask(texts, odd, pa.array([make(t) for t in texts.filter(odd).to_pylist()], texts.type))


def in_order(table: pa.Table, word: np.ndarray, order: str) -> pa.Table:
    """A table of whole pairs with each pair's rows in order of side (pdf first) and ordinal."""
    pair, rank = pairs_of(table.column(0).chunk(0)), pc.fill_null(table.column(order).chunk(0), -(1 << 31)).to_numpy()
    return table.take(pa.array(np.lexsort((rank, word, pair)))).combine_chunks()


def word_side(side: pa.Array) -> np.ndarray:
    return (side if pa.types.is_boolean(side.type) else pc.equal(side, "word")).to_numpy(zero_copy_only=False)


def pairs_of(column: pa.Array) -> np.ndarray:
    """The number of the pair of each row, from 0, where a pair's rows stand together."""
    code = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.cumsum(np.append(False, code[1:] != code[:-1])[: len(code)])


def listed(texts: pa.Array) -> list:
    """``to_pylist`` of texts, without a scalar object for each."""
    return texts.to_numpy(zero_copy_only=False).tolist()


def aligned(col: dict[str, pa.Array], threshold: float, reach: int, semantic: bool, least: int) -> tuple[np.ndarray, ...]:
    """Row of the word side, of the pdf side (-1: none), kind of match (a place in KINDS), similarity, covered and align_idx of all pairs of a table.

    Rows are in order of pair, side (pdf first) and ordinal. Numbers and fields are matched for the whole table at once; only pairs
    with a clause on both sides that they leave take a turn in Python.
    """
    pair, word = pairs_of(col[PAIR]), word_side(col["side"])
    w, p = _by_key(pair, word, col["number"], col["level"], "pdf")
    if col[PAIR].null_count:  # nothing equals null
        known = col[PAIR].is_valid().to_numpy(zero_copy_only=False)[w]
        w, p = w[known], p[known]
    free = np.ones(len(pair), bool)
    free[w] = free[p] = False
    left = np.flatnonzero(free)
    made: list[tuple] = []
    lone = fw = fp = left[:0]
    if len(left):
        known = col[PAIR].is_valid().to_numpy(zero_copy_only=False)
        at = left[known[left]]
        fw, fp = (at[x] for x in _by_key(pair[at], word[at], col["field_key"].take(pa.array(at)), pa.nulls(len(at), pa.int32()).fill_null(0), "word"))
        free[fw] = free[fp] = False
        left = left[free[left]]
    if len(left):
        cuts = np.flatnonzero(np.append(True, pair[left][1:] != pair[left][:-1]))
        n_all, n_pdf = np.diff(np.append(cuts, len(left))), np.add.reduceat((~word[left]).astype(np.int64), cuts)
        meet = np.repeat((n_pdf > 0) & (n_pdf < n_all) & known[left[cuts]] & semantic, n_all)  # clauses of one side alone, or of no pair, meet nothing
        left, lone = left[meet], left[~meet]
        rows = left.tolist()
        text = dict(zip(rows, listed(col["text"].take(pa.array(left))), strict=True))
        cuts = np.flatnonzero(np.append(True, pair[left][1:] != pair[left][:-1])[: len(left)])
        n_pdf = np.add.reduceat((~word[left]).astype(np.int64), cuts) if len(cuts) else cuts
        for a, b, n in zip(cuts.tolist(), [*cuts[1:].tolist(), len(rows)], n_pdf.tolist(), strict=len(cuts) > 0):
            made += _left(rows[a + n : b], rows[a : a + n], text, threshold, reach)
    none = lambda i: np.array([-1 if r[i] is None else r[i] for r in made], np.int64)
    kind = [np.full(len(w), KINDS.index("number")), np.full(len(fw), KINDS.index("field")), np.array([KINDS.index(r[2]) for r in made], int), np.full(len(lone), KINDS.index("unmatched"))]
    kind = np.concatenate(kind).astype(np.int8)
    similarity = np.concatenate([np.ones(len(w) + len(fw)), np.array([r[3] for r in made], float), np.zeros(len(lone))])
    w, p = np.concatenate([w, fw, none(0), np.where(word[lone], lone, -1)]), np.concatenate([p, fp, none(1), np.where(word[lone], -1, lone)])
    of = pair[np.maximum(w, p)] if len(w) else w
    order = np.argsort(of, kind="stable")
    w, p, kind, similarity, of = (x[order] for x in (w, p, kind, similarity, of))
    starts = np.flatnonzero(np.append(True, of[1:] != of[:-1])[: len(of)])
    index = np.arange(len(of)) - np.repeat(starts, np.diff(np.append(starts, len(of))))
    covered = np.zeros(len(w), bool)
    if len(made) or len(lone):
        covered = _covered(w, p, pair, word, pc.fill_null(col["clause_ord"], -(1 << 31)).to_numpy().astype(np.int64), col["text"], least)
        if col[PAIR].null_count:
            covered &= col[PAIR].is_valid().to_numpy(zero_copy_only=False)[np.maximum(w, p)]
    return w, p, kind, similarity, covered, index


def _rows(clauses: DataFrame, columns: list[str], together: bool) -> DataFrame:
    rows = clauses.where("side in ('word', 'pdf')").select(PAIR, "side", "clause_ord", *columns)
    # The window brings a pair's rows together, unless they are so already; its column goes along, so that it is not dropped.
    return rows if together else rows.withColumn("n", F.row_number().over(Window.partitionBy(PAIR).orderBy("side", "clause_ord")))


#: Columns of rows that have the clauses of both sides: without an ordinal a side has none, and a null of the pdf side's number or text is the word side's.
FOLDED = [PAIR, "word_clause_ord", "pdf_clause_ord", "level", "field_key", "w_number", "p_number", "w_text", "p_text"]
#: Rows and bytes of tables that are judged at once; a pair is never parted.
ROWS, SIZE = 1 << 15, 1 << 24


def unfolded(table: pa.Table) -> dict[str, pa.Array]:
    """The columns of ``in_order``, one clause in each row, of a table with rows of both sides (FOLDED); ``side`` says whether it is word."""
    one = {c: table.column(c).chunk(0) for c in FOLDED}
    orders = [one["pdf_clause_ord"], one["word_clause_ord"]]
    rows = [np.flatnonzero(x.is_valid().to_numpy(zero_copy_only=False)) for x in orders]
    pair, n = pairs_of(one[PAIR]), table.num_rows
    word = np.repeat([False, True], [len(x) for x in rows])
    rank = np.concatenate([x.drop_null().to_numpy() for x in orders])
    order = np.lexsort((rank, word, np.concatenate([pair[x] for x in rows])))
    own = np.concatenate(rows)[order]
    at, two = pa.array(own), pa.array(own + n * word[order])
    col = {c: one[c].take(at) for c in (PAIR, "level", "field_key")} | {"side": pa.array(word[order]), "clause_ord": pa.array(rank[order])}
    return col | {c: pa.concat_arrays([pc.coalesce(one[f"p_{c}"], one[f"w_{c}"]), one[f"w_{c}"]]).take(two) for c in ("number", "text")}


def _tables(batches: Iterator[pa.RecordBatch], make, rows: int = 1, size: int = 0) -> Iterator[dict[str, pa.Array]]:
    """The columns of whole pairs in order, texts by ``make`` if there is one."""
    for table in whole_pairs(batches, rows, size):
        if "side" in table.column_names:
            table = in_order(table, word_side(table.column("side").chunk(0)), "clause_ord")
            col = {c: table.column(c).chunk(0) for c in table.column_names}
        else:
            col = unfolded(table)
        if make:
            col["text"] = tidied(col["text"], make)
        yield col


def matched(clauses: DataFrame, threshold: float = 0.70, reach: int = 5, semantic: bool = True, least: int = 4, unicode: bool = False, together: bool = False) -> DataFrame:
    """``align`` with the columns of both sides (w_*, p_*) and ``covered``, as ``covered()`` says of unmatched fragments.

    A pair's clauses meet in one task, once; Python sees the keys and texts of clauses that numbers leave (``unicode``: all
    texts come out as ``normalize_text`` makes them). All else stays in Arrow. ``together``: each pair's rows stand
    together in one partition already, in any order, so nothing is dealt out or sorted.
    """
    carried = [c for c in ("number", "title", "text", "level", "field_key", "tables") if c in clauses.columns]
    rows = _rows(clauses, carried, together)
    kind = {f.name: f.dataType for f in rows.schema}
    fields = [(PAIR, kind[PAIR]), ("align_idx", IntegerType()), *[(f"{s}_clause_ord", kind["clause_ord"]) for s in ("word", "pdf")], ("match_type", StringType()), ("similarity", DoubleType())]
    fields += [("covered", BooleanType()), *[(f"{s}_{c}", kind[c]) for s in "wp" for c in carried]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for col in _tables(batches, normal_text if unicode else None):
            w, p, match, similarity, hidden, index = aligned(col, threshold, reach, semantic, least)
            own, (w, p) = pa.array(np.maximum(w, p)), (pa.array(x, mask=x < 0) for x in (w, p))
            out = [col[PAIR].take(own), pa.array(index, pa.int32()), col["clause_ord"].take(w), col["clause_ord"].take(p), named(match, KINDS)]
            out += [pa.array(similarity), pa.array(hidden), *[col[c].take(i) for i in (w, p) for c in carried]]
            yield pa.RecordBatch.from_arrays(out, names=[f[0] for f in fields])

    return rows.mapInArrow(run, StructType([StructField(*f) for f in fields]))


def named(code: np.ndarray, names: list[str]) -> pa.Array:
    return pa.DictionaryArray.from_arrays(pa.array(code, pa.int8()), pa.array(names)).cast(pa.string())


def _judged(col: dict[str, pa.Array], threshold: float, reach: int, semantic: bool, least: int, identical: float, modified: float) -> tuple[np.ndarray, ...]:
    """Of each alignment of a table that is not covered: row of the word side, of the pdf side, align_idx, places of its status and risk, and a column for each kind of value: changed?"""
    w, p, match, similarity, hidden, index = aligned(col, threshold, reach, semantic, least)
    w, p, match, similarity, index = (x[~hidden] for x in (w, p, match, similarity, index))
    status, risk = np.zeros(len(w), np.int8), np.zeros(len(w), np.int8)
    lone = np.flatnonzero((w < 0) | (p < 0))
    status[w < 0], status[p < 0] = STATUS.index("added"), STATUS.index("deleted")
    plain = pc.equal(pc.fill_null(col["number"].take(pa.array(np.maximum(w, p)[lone])), ""), "").to_numpy(zero_copy_only=False)
    risk[lone] = np.where(plain, RISK.index("low"), RISK.index("high"))
    both = np.flatnonzero((w >= 0) & (p >= 0))
    left, right = col["text"].take(pa.array(w[both])), col["text"].take(pa.array(p[both]))
    differ = pc.fill_null(pc.not_equal(left, right), True)  # a null text has no verdict of its own
    odd = both[differ.to_numpy(zero_copy_only=False)]
    left, right = (pc.fill_null(x.filter(differ), "") for x in (left, right))
    found = np.zeros((len(w), len(VALUES)), bool)
    found[odd] = changes(left, right)
    hit = found[odd].any(axis=1)
    status[odd[hit]], risk[odd[hit]] = STATUS.index("modified"), RISK.index("high")
    rest = pa.array(np.flatnonzero(~hit))
    for i, a, b in zip(odd[~hit].tolist(), listed(left.take(rest)), listed(right.take(rest)), strict=True):
        if a == b:
            continue
        value = bag_similarity(a, b) if match[i] == 0 else similarity[i]
        if value < identical:
            status[i], risk[i] = STATUS.index("modified"), RISK.index("medium" if value < modified else "low")
    return w, p, index, status, risk, found


def _judging(clauses: DataFrame, together: bool, unicode: bool, limits: tuple, schema, made) -> DataFrame:
    """What ``made`` makes of the columns of each table and ``_judged`` of it; ``schema``: of the type of the pair."""
    folded = "side" not in clauses.columns
    if folded and not together:
        raise ValueError("rows of both sides must stand together")
    rows = clauses.select(*FOLDED) if folded else _rows(clauses, ["number", "level", "field_key", "text"], together)
    fields = schema(rows.schema[PAIR].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for col in _tables(batches, normal_text if unicode else None, ROWS, SIZE):
            yield pa.RecordBatch.from_arrays(made(col, *_judged(col, *limits)), names=[f[0] for f in fields])

    return rows.mapInArrow(run, StructType([StructField(*f) for f in fields]))


def verdicts(clauses: DataFrame, threshold: float = 0.70, reach: int = 5, semantic: bool = True, least: int = 4, unicode: bool = True, together: bool = False,
             identical: float = 0.98, modified: float = 0.85) -> DataFrame:
    """pair_id, align_idx, status, risk_level, number and changed_kinds of each alignment that is not covered, made in the task that matches it.

    As ``judged`` of ``matched`` for clauses without tables, but no text leaves the task, and only unequal texts become
    Python values: all patterns that they can fulfil are looked for, and bags are made where no value has changed. Clauses
    that are ``together`` can also come as rows of both sides (FOLDED), so that what the sides have alike travels once.
    """
    fields = lambda kind: [(PAIR, kind), ("align_idx", IntegerType()), *[(c, StringType()) for c in ("status", "risk_level", "number")], ("changed_kinds", ArrayType(StringType()))]

    def made(col, w, p, index, status, risk, found):
        at, of = (pa.array(x, mask=x < 0) for x in (w, p))
        number = pc.coalesce(col["number"].take(at), col["number"].take(of))
        return [col[PAIR].take(pa.array(np.maximum(w, p))), pa.array(index, pa.int32()), named(status, STATUS), named(risk, RISK), number, lists(found, VALUES)]

    return _judging(clauses, together, unicode, (threshold, reach, semantic, least, identical, modified), fields, made)


def verdict_counts(clauses: DataFrame, threshold: float = 0.70, reach: int = 5, semantic: bool = True, least: int = 4, unicode: bool = True, together: bool = False,
                   identical: float = 0.98, modified: float = 0.85) -> DataFrame:
    """status, risk_level and how many of the ``verdicts`` have them; counted in the task that judges, and then over all tasks."""
    fields = lambda _: [("status", StringType()), ("risk_level", StringType()), ("n", LongType())]

    def made(col, w, p, index, status, risk, found):
        code, n = np.unique(status.astype(np.int64) * len(RISK) + risk, return_counts=True)
        return [named(code // len(RISK), STATUS), named(code % len(RISK), RISK), pa.array(n, pa.int64())]

    parts = _judging(clauses, together, unicode, (threshold, reach, semantic, least, identical, modified), fields, made)
    return parts.groupBy("status", "risk_level").agg(F.sum("n").alias("n"))


def severities(clauses: DataFrame, threshold: float = 0.70, reach: int = 5, semantic: bool = True, least: int = 4, unicode: bool = True, together: bool = False,
               identical: float = 0.98, modified: float = 0.85) -> DataFrame:
    """pair_id, align_idx, risk_level and severity_ord of the ``verdicts`` that are not identical: ``compare.by_severity``, in the task that has the whole pair."""
    fields = lambda kind: [(PAIR, kind), ("align_idx", IntegerType()), ("risk_level", StringType()), ("severity_ord", IntegerType())]

    def made(col, w, p, index, status, risk, found):
        shown = np.flatnonzero(status != STATUS.index("identical"))
        own = np.maximum(w, p)[shown]
        pair = pairs_of(col[PAIR])[own]
        order = np.lexsort((index[shown], -risk[shown], pair))
        own, pair, shown = own[order], pair[order], shown[order]
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])[: len(pair)])
        place = 1 + np.arange(len(pair)) - np.repeat(first, np.diff(np.append(first, len(pair))))
        return [col[PAIR].take(pa.array(own)), pa.array(index[shown], pa.int32()), named(risk[shown], RISK), pa.array(place, pa.int32())]

    return _judging(clauses, together, unicode, (threshold, reach, semantic, least, identical, modified), fields, made)


def lists(found: np.ndarray, names: list[str]) -> pa.Array:
    """The names of each row's true columns."""
    kinds = named(np.nonzero(found)[1], names)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(found.sum(axis=1))), pa.int32()), kinds)


def align(clauses: DataFrame, threshold: float = 0.70, reach: int = 5, semantic: bool = True) -> DataFrame:
    """The alignment list of each pair: align_idx from 0, ordinals of both sides (null: none), match_type, similarity.

    Order: number pairs by the pdf key's first appearance, field pairs by the
    word key's, remaining pdf clauses, remaining word clauses.
    """
    c = clauses if semantic else clauses.withColumn("text", F.lit(""))
    return matched(c.select(PAIR, "side", "clause_ord", "number", "level", "field_key", "text"), threshold, reach, semantic).select(PAIR, *ALIGNMENT)


def statistics(alignments: DataFrame) -> DataFrame:
    """Counts by kind of match, unmatched ones as added (pdf alone) and deleted (word alone)."""
    when = lambda c: F.count_if(F.expr(c))
    return alignments.groupBy(PAIR).agg(
        when("match_type = 'number'").alias("n_number"), when("match_type = 'field'").alias("n_field"), when("match_type = 'semantic'").alias("n_semantic"),
        when("word_clause_ord is null").alias("n_added"), when("pdf_clause_ord is null").alias("n_deleted"),
    )


def covered(alignments: DataFrame, clauses: DataFrame, least: int = 4, unicode: bool = True) -> DataFrame:
    """pair_id, align_idx of unmatched fragments that the partner of a paired neighbour contains.

    Neighbours stand at ordinal distance 1 on the fragment's own side; the
    fragment has ``least`` compact characters or more.
    """
    from redline.functions.text import compact

    texts = clauses.select(PAIR, "side", "clause_ord", compact(F.col("text"), unicode).alias("c"))
    out = None
    for own, other in (("word", "pdf"), ("pdf", "word")):
        alone = alignments.where(f"{other}_clause_ord is null").select(PAIR, "align_idx", F.col(f"{own}_clause_ord").alias("clause_ord"))
        fragment = alone.join(texts.where(F.col("side") == own), [PAIR, "clause_ord"]).where(F.length("c") >= least)
        near = fragment.select(PAIR, "align_idx", "c", F.explode(F.array(F.col("clause_ord") - 1, F.col("clause_ord") + 1)).alias(f"{own}_clause_ord"))
        paired = alignments.where("word_clause_ord is not null and pdf_clause_ord is not null").select(PAIR, "word_clause_ord", "pdf_clause_ord")
        partner = texts.where(F.col("side") == other).select(PAIR, F.col("clause_ord").alias(f"{other}_clause_ord"), F.col("c").alias("whole"))
        hit = near.join(paired, [PAIR, f"{own}_clause_ord"]).join(partner, [PAIR, f"{other}_clause_ord"]).where(F.contains("whole", "c"))
        hit = hit.select(PAIR, "align_idx").distinct()
        out = hit if out is None else out.unionByName(hit)
    return out
