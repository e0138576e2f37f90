"""Arrow-batched kernels for what no built-in function computes."""

from __future__ import annotations

import difflib
import hashlib
import hmac
import re
import unicodedata
from collections import _count_elements
from functools import lru_cache
from math import sqrt, sumprod
from operator import add

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

# Type objects: a worker that imports this module has no session to parse a type's text.
SEGMENTS = ArrayType(StructType([StructField("op", StringType()), StructField("text", StringType())]))


def opcodes(a, b) -> list[tuple[str, int, int, int, int]]:
    return difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()


def segments(left: str, right: str) -> list[dict[str, str]]:
    """Equal, delete and insert segments; a replacement is a deletion and then an insertion."""
    out = []
    for tag, a, b, c, d in opcodes(left, right):
        if tag == "equal":
            out.append({"op": "equal", "text": left[a:b]})
            continue
        if b > a:
            out.append({"op": "delete", "text": left[a:b]})
        if d > c:
            out.append({"op": "insert", "text": right[c:d]})
    return out


def row_segments(left: list[str], right: list[str]) -> list[dict[str, str]]:
    """Segments of two tables given as row texts: whole rows end with a line feed, replaced rows pair by position."""
    out = []
    for tag, a, b, c, d in opcodes(left, right):
        common = min(b - a, d - c) if tag == "replace" else 0
        for i in range(common):
            out += [*segments(left[a + i], right[c + i]), {"op": "equal", "text": "\n"}]
        if tag == "equal":
            out += [{"op": "equal", "text": row + "\n"} for row in left[a:b]]
        else:
            out += [{"op": "delete", "text": row + "\n"} for row in left[a + common : b]]
            out += [{"op": "insert", "text": row + "\n"} for row in right[c + common : d]]
    return out


def longest_common_substring(a: str, b: str) -> int:
    """By a suffix automaton of the shorter text: linear in both lengths."""
    if len(a) > len(b):
        a, b = b, a
    step, link, size = [{}], [-1], [0]
    last = 0
    for ch in a:
        here = len(step)
        step.append({}), link.append(0), size.append(size[last] + 1)
        p = last
        while p >= 0 and ch not in step[p]:
            step[p][ch] = here
            p = link[p]
        if p >= 0:
            q = step[p][ch]
            if size[q] == size[p] + 1:
                link[here] = q
            else:
                clone = len(step)
                step.append(dict(step[q])), link.append(link[q]), size.append(size[p] + 1)
                while p >= 0 and step[p].get(ch) == q:
                    step[p][ch] = clone
                    p = link[p]
                link[q] = link[here] = clone
        last = here
    state = run = best = 0
    for ch in b:
        while state and ch not in step[state]:
            state = link[state]
            run = size[state]
        if ch in step[state]:
            state, run = step[state][ch], run + 1
        best = max(best, run)
    return best


#: Product of lengths up to which a common substring is grown by looking it up; longer texts take the automaton.
SHORT = 1 << 16


def common_ratio(a: str, b: str) -> float:
    """Longest common substring over the shorter length; 0 if either is empty."""
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    if len(a) * len(b) > SHORT:
        return longest_common_substring(a, b) / len(a)
    at = best = 0
    while at + best < len(a):
        if a[at : at + best + 1] in b:
            best += 1
        else:
            at += 1
    return best / len(a)


_token = re.compile("[\u4e00-\u9fff]|[a-zA-Z0-9]+")


def bag(text: str) -> dict[str, int]:
    """Counts of adjacent token pairs, joined, and of tokens."""
    ts = _token.findall(text)
    if text.lower() != text:
        ts = [t.lower() for t in ts]
    counts: dict[str, int] = {}
    _count_elements(counts, [*map(add, ts, ts[1:]), *ts])  # what a Counter does, without its checks
    return counts


def bag_norm(b: dict[str, int]) -> float:
    return sqrt(sumprod(b.values(), b.values()))


def bag_dot(x: dict[str, int], y: dict[str, int]) -> int:
    both = x.keys() & y.keys()
    return sumprod(map(x.get, both), map(y.get, both))


@lru_cache(64)
def bag_and_norm(text: str) -> tuple[dict[str, int], float]:
    """For reading alone: both sides of a pair often have one text, and a text meets several."""
    b = bag(text)
    return b, bag_norm(b)


def bag_similarity(a: str, b: str) -> float:
    x, y = bag(a), bag(b)
    norm = bag_norm(x) * bag_norm(y)
    return bag_dot(x, y) / norm if norm else 0.0


#: The blanks of \\s with (?U) in Java, for a class of characters.
BLANKS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_blank, _blank_run = re.compile(f"[{BLANKS}]"), re.compile("[" + BLANKS.replace("\t-\r", "\t\x0b-\r") + "]+")
_edges = re.compile(f"^[{BLANKS}]+|[{BLANKS}]+\\Z")


def normal_text(text: str) -> str:
    """What ``text.normalize_text`` makes of one text."""
    s = text if text.isascii() else unicodedata.normalize("NFKC", text)
    if not _blank.search(s):
        return s
    n = _blank_run.sub(" ", s.replace("\r\n", "\n").replace("\r", "\n"))
    return _edges.sub("", re.sub("\n{2,}", "\n", n))


@pandas_udf(DoubleType())
def bag_cosine(left: pd.Series, right: pd.Series) -> pd.Series:
    """Null where a text is."""
    return pd.Series([None if a is None or b is None else bag_similarity(a, b) for a, b in zip(left, right, strict=True)], dtype=float)


@pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


@pandas_udf(SEGMENTS)
def char_diff(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([segments(a or "", b or "") for a, b in zip(left, right, strict=True)])


@pandas_udf(SEGMENTS)
def table_diff(left: pd.Series, right: pd.Series) -> pd.Series:
    none = lambda x: [] if x is None else list(x)
    return pd.Series([row_segments(none(a), none(b)) for a, b in zip(left, right, strict=True)])


@pandas_udf(DoubleType())
def substring_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Longest common substring over the shorter length; 0 if either is empty."""
    return pd.Series([common_ratio(a, b) for a, b in zip(left, right, strict=True)], dtype=float)


def signer(secret: str):
    """A column function: the hex HMAC-SHA256 of a text's UTF-8 bytes."""

    @pandas_udf(StringType())
    def sign(body: pd.Series) -> pd.Series:
        return body.map(lambda b: hmac.new(secret.encode(), b.encode(), hashlib.sha256).hexdigest())

    return sign


def verify_signature(secret: str, body: bytes, signature: str) -> bool:
    return hmac.compare_digest(hmac.new(secret.encode(), body, hashlib.sha256).hexdigest(), signature)
