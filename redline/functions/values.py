"""High-risk values in texts."""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from redline.functions.kernels import BLANKS
from redline.functions.text import without_blanks

# Patterns and keywords by kind.
PATTERNS = {
    "amount": [r"[¥￥]\s*[\d,，.]+\s*(?:万元?|元)?", r"[\d,，.]+\s*(?:万元|元)", r"[壹贰叁肆伍陆柒捌玖拾佰仟万亿零整圆]{2,}元?"],
    "date": [r"\d{4}\s*年\s*\d{1,2}\s*月(?:\s*\d{1,2}\s*日)?", r"\d{4}[-/]\d{1,2}[-/]\d{1,2}", r"\d+\s*个?\s*(?:工作日|天|日|个月|月)"],
    "ratio": [r"\d+(?:\.\d+)?\s*%", r"百分之[一二三四五六七八九十百\d]+"],
}
KEYWORDS = {
    "breach": ["违约", "赔偿", "滞纳金", "罚息"],
    "jurisdiction": ["诉讼", "仲裁", "管辖", "法院"],
    "effective": ["生效", "解除", "终止"],
}
SEVERE = ["amount", "date"]
# End of fixed values.
KINDS = sorted([*PATTERNS, *KEYWORDS])


def values(norm: Column, kind: str) -> Column:
    """The sorted distinct values of one kind in a normalised text."""
    found = F.concat(*[F.regexp_extract_all(norm, F.lit("(?U)" + p), F.lit(0)) for p in PATTERNS[kind]])
    return F.array_sort(F.array_distinct(F.transform(found, without_blanks)))


def keywords(norm: Column, kind: str) -> Column:
    return F.array_sort(F.filter(F.array(*[F.lit(k) for k in KEYWORDS[kind]]), lambda k: F.contains(norm, k)))


def of_kind(norm: Column, kind: str) -> Column:
    return (values if kind in PATTERNS else keywords)(norm, kind)


def elements(norm: Column, with_keywords: bool = True) -> Column:
    """array<struct<kind, vals>> of the kinds that occur, in order of kind."""
    kinds = sorted([*PATTERNS, *(KEYWORDS if with_keywords else [])])
    each = [F.struct(F.lit(k).alias("kind"), of_kind(norm, k).alias("vals")) for k in kinds]
    return F.filter(F.array(*each), lambda e: F.size(e["vals"]) > 0)


#: Each pattern with the characters of which a text must have one to fulfil it ('': no such).
_need = {"amount": ["¥￥", "元", ""], "date": ["年", "-/", "天日月"], "ratio": ["%", "百"]}
_compiled = [(k, need, re.compile(p.replace(r"\s", f"[{BLANKS}]"))) for k, ps in PATTERNS.items() for need, p in zip(_need[k], ps, strict=True)]
_blanks = re.compile(f"[{BLANKS}]+")
#: No pattern looks beyond what it matches, and none matches another character than these: values lie within runs of them.
_run = re.compile(rf"[¥￥,，.万元壹贰叁肆伍陆柒捌玖拾佰仟亿零整圆年月日/个工作天%百分之一二三四五六七八九十\d{BLANKS}-]+")


@functools.lru_cache(1 << 15)
def _values(run: str) -> frozenset[tuple[str, str]]:
    return frozenset((kind, _blanks.sub("", m)) for kind, need, p in _compiled if not need or any(c in run for c in need) for m in p.findall(run))


def changed_kinds(left: str, right: str) -> list[str]:
    """The kinds whose values (see ``of_kind``) two normalised texts don't have alike, in order of kind."""
    a, b = set(_run.findall(left)), set(_run.findall(right))
    found = {v for r in a - b for v in _values(r)} ^ {v for r in b - a for v in _values(r)}
    kinds = {kind for kind, _ in found.difference(*map(_values, a & b))} if found else set()
    kinds |= {kind for kind, words in KEYWORDS.items() if any((k in left) != (k in right) for k in words)}
    return sorted(kinds)


#: Texts longer than this are not kept by their form.
FORM = 512
_zeros = np.arange(256, dtype=np.uint8)
_zeros[48:58] = 48


def forms(texts: pa.Array) -> pa.Array:
    """Each text with 0 for its ASCII digits: no pattern or keyword tells one digit from another, so equal forms have their values at equal places."""
    texts = texts.cast(pa.large_string())
    offsets, data = texts.buffers()[1:]
    zeros = pa.py_buffer(_zeros[np.frombuffer(data, np.uint8)]) if data else data
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, zeros], offset=texts.offset)


@functools.lru_cache(1 << 12)
def _places(left: str, right: str) -> list[tuple[int, list[tuple[int, int, int]], list[tuple[list[slice], list[slice]]]]] | None:
    """What decides over each kind (a place in KINDS) whose values two forms can have unlike; None where values hold blanks.

    Values of unlike forms are unlike, so each form of a value stands for itself. One that both sides have once: start on the
    left, start on the right and length in bytes. One that they have more often: the places of both sides. A kind with
    neither is unlike, whatever the digits are.
    """
    out = []
    for k, kind in enumerate(KINDS):
        if kind in KEYWORDS:
            if any((x in left) != (x in right) for x in KEYWORDS[kind]):
                out.append((k, [], []))
            continue
        both: list[dict[str, list[slice]]] = [{}, {}]
        for text, by_form in zip((left, right), both, strict=True):
            for a, b in sorted({m.span() for x, _, p in _compiled if x == kind for m in p.finditer(text)}):
                by_form.setdefault(text[a:b], []).append(slice(a, b))
        if any(_blanks.search(form) for by_form in both for form in by_form):
            return None
        if both[0].keys() != both[1].keys():
            out.append((k, [], []))
        elif both[0]:
            at = lambda text, x: len(text[: x.start].encode())
            alike = [(form, xs, both[1][form]) for form, xs in both[0].items()]
            once = [(at(left, xs[0]), at(right, ys[0]), len(form.encode())) for form, xs, ys in alike if len(xs) == len(ys) == 1]
            out.append((k, once, [(xs, ys) for _, xs, ys in alike if len(xs) + len(ys) > 2]))
    return out


def _raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text starts, and the bytes of all."""
    texts = texts.cast(pa.large_string())
    offsets, data = texts.buffers()[1:]
    return np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts)], np.frombuffer(data or b"", np.uint8)


def changes(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Of many pairs of texts without nulls, a column for each of KINDS: are its values changed (see ``changed_kinds``)?

    Forms that two pairs or more have are searched once, and their values compared by place, for all their pairs at once.
    """
    n, out = len(left), np.zeros((len(left), len(KINDS)), bool)
    if not n:
        return out
    coded = pa.concat_arrays([forms(left), forms(right)]).dictionary_encode()
    code, form = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    pairs, of, times = np.unique(code[:n] * len(form) + code[n:], return_inverse=True, return_counts=True)
    short = pc.less_equal(pc.utf8_length(form), FORM).to_numpy(zero_copy_only=False)
    often = (times > 1) & short[pairs // len(form)] & short[pairs % len(form)]
    order, ends = np.argsort(of, kind="stable"), np.cumsum(times)
    alone = [order[~often[of[order]]]]
    (starts, data), (others, more) = _raw(left), _raw(right)
    for i in np.flatnonzero(often).tolist():
        rows, (a, b) = order[ends[i] - times[i] : ends[i]], divmod(int(pairs[i]), len(form))
        if (known := _places(form[a].as_py(), form[b].as_py())) is None:
            alone.append(rows)
            continue
        for k, once, repeated in known:
            if not once and not repeated:
                out[rows, k] = True
                continue
            hit = np.zeros(len(rows), bool)
            for x, y, size in once:
                step = np.arange(size)
                hit |= (data[(starts[rows] + x)[:, None] + step] != more[(others[rows] + y)[:, None] + step]).any(axis=1)
            if repeated:
                for j in np.flatnonzero(~hit).tolist():
                    a, b = (t[int(rows[j])].as_py() for t in (left, right))
                    hit[j] = any({a[s] for s in xs} != {b[s] for s in ys} for xs, ys in repeated)
            out[rows, k] = hit
    rows = np.concatenate(alone)
    if len(rows):
        texts = [t.take(pa.array(rows)).to_numpy(zero_copy_only=False).tolist() for t in (left, right)]
        for i, a, b in zip(rows.tolist(), *texts, strict=True):
            for kind in changed_kinds(a, b):
                out[i, KINDS.index(kind)] = True
    return out


def changed_kinds_of(left: pa.Array, right: pa.Array) -> list[list[str]]:
    """``changed_kinds`` of many pairs of texts without nulls."""
    found = changes(left, right)
    hit = found.any(axis=1).tolist()
    return [[k for k, x in zip(KINDS, row, strict=True) if x] if any_ else [] for any_, row in zip(hit, found.tolist(), strict=True)]
