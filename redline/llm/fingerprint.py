"""Document fingerprints by content-defined chunking.

A gear hash over a text's UTF-8 bytes marks where chunks may end; normalised
chunking asks a strict mask before the normal size and a loose one after it. A
fingerprint is the set of the chunks' digests with their lengths, so an
insertion changes the chunks around it and no other. Likeness is containment:
the share of a text's bytes whose chunks the other fingerprint holds too.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from redline.llm.common import CHUNK_CHARS, mix64

#: Sizes of chunks in bytes, and how many bits of the gear hash must be 0 before and after the normal size.
LEAST, NORMAL, MOST, STRICT, LOOSE = 8, 24, 128, 6, 3
#: Bytes of text that one block of keys has.
BLOCK = 2 << 20
_gear = (mix64(np.arange(1, 257, dtype=np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)


def gear(data: bytes) -> np.ndarray:
    """The rolling hash of the 16 bytes up to each byte, by doubling: windows of 1, 2, 4, 8 and 16."""
    h = _gear[np.frombuffer(data, np.uint8)]
    for span in (1, 2, 4, 8):
        wider = h.copy()
        wider[span:] += h[:-span] << np.uint16(span)
        h = wider
    return h


def chunks(data: bytes) -> list[bytes]:
    """The chunks of ``data``, whose concatenation it is."""
    n = len(data)
    if n <= LEAST:
        return [data] if n else []
    h = gear(data)
    loose = np.flatnonzero(h >> np.uint16(16 - LOOSE) == 0)
    strict = loose[h[loose] >> np.uint16(16 - STRICT) == 0].tolist()
    loose, out, start = loose.tolist(), [], 0
    while start < n:
        normal, most = start + NORMAL, min(start + MOST, n)
        i = bisect_left(strict, start + LEAST - 1)
        end = strict[i] + 1 if i < len(strict) and strict[i] < normal else 0
        if not end:
            i = bisect_left(loose, normal)
            end = loose[i] + 1 if i < len(loose) and loose[i] < most else most
        out.append(data[start:end])
        start = end
    return out


def fingerprint(text: str) -> dict[int, int]:
    """Bytes of the text by 40-bit digest of their chunk; a repeated chunk counts each time."""
    found: dict[int, int] = {}
    for c in chunks(text.encode("utf-8", "surrogatepass")):
        d = xxhash.xxh3_64_intdigest(c) >> 24
        found[d] = found.get(d, 0) + len(c)
    return found


def written(found: dict[int, int]) -> str:
    """A fingerprint as text: digests in order, each with its length, in hex."""
    return " ".join([f"{d:010x}{n:x}" for d, n in sorted(found.items())])


def read(text: str) -> dict[int, int]:
    return {int(x[:10], 16): int(x[10:], 16) for x in text.split()}


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """The share of a's bytes in chunks that b has; 1 for two empty ones, 0 if one alone is empty."""
    if not a or not b:
        return float(not a and not b)
    return sum(n for d, n in a.items() if d in b) / sum(a.values())


def edited(text: str, following: str) -> str:
    """``text`` with its last third of code points replaced by as many from the start of ``following`` (or all)."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def in_order(df: DataFrame, key: str, text: str) -> DataFrame:
    """Columns block, copy, key and text: blocks of keys from the largest down, ready to be read in order.

    Each block has about BLOCK bytes of text and, as a row with copy = 1, the first
    row of the block after it (the last block: of the first). Null keys come
    last; rows of one key are ordered by text. Only a few numbers for each
    block come to the driver, so there are 16,384 blocks at most: beyond 32 GB
    of text they grow with it. A block, and so a key that very many rows have,
    is sorted on disk and read as a stream: its size costs a task time, not memory.
    """
    rows = df.select(F.col(f"`{key}`").cast("long").alias("k"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    sizes = rows.agg(F.sum(F.octet_length("t")).alias("bytes"), F.count("*").alias("n")).first()
    n_blocks = max(1, min(1 << 14, -(-(sizes["bytes"] or 0) // BLOCK)))
    if n_blocks > 1:
        cut = rows.select(F.percentile_approx("k", [i / n_blocks for i in range(1, n_blocks)], 100 * n_blocks)).first()[0]
        cuts = sorted(set(cut or []))
    else:
        cuts = []
    # block 0 has the largest keys
    placed = rows.withColumn("block", F.when(F.col("k").isNull(), len(cuts) + 1).otherwise(len(cuts) - _at_most(cuts)).cast("int"))
    heads = placed.groupBy("block").agg(F.max("k").alias("k")).collect()
    order = sorted(heads, key=lambda r: r["block"])
    if not order:
        return placed.select("block", F.lit(0).alias("copy"), "k", "t")
    to = {r["block"]: order[i - 1]["block"] for i, r in enumerate(order)}  # the block before; the first: the last
    head = F.create_map(*[F.lit(x) for r in order for x in (r["block"], r["k"])])
    prior = F.create_map(*[F.lit(x) for pair in to.items() for x in pair])
    first = placed.where(F.col("k").eqNullSafe(head[F.col("block")]))
    firsts = first.groupBy("block").agg(F.min("t").alias("t"), F.first("k").alias("k"))
    copies = firsts.select(prior[F.col("block")].alias("block"), F.lit(1).alias("copy"), "k", "t")
    return placed.select("block", F.lit(0).alias("copy"), "k", "t").unionByName(copies)


def _at_most(cuts: list[int], group: int = 256) -> Column:
    """How many of the sorted cuts are no more than k: first among every ``group``-th, then in that one's group."""
    if not cuts:
        return F.lit(0)
    parts = [cuts[i : i + group] for i in range(0, len(cuts), group)]
    count = lambda cs: F.size(F.filter(cs, lambda c: c <= F.col("k")))
    array = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<bigint>")
    at = count(array(p[0] for p in parts)) - 1
    fine = F.get(F.array(*[array(p) for p in parts]), at)
    return F.when(at < 0, 0).otherwise(at * group + count(fine))


def compare_with_next(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text with its fingerprint, that of its edited text, and the likeness of its own to that and the next one's.

    Columns: key, n_chars, edited_text, fingerprint, edited_fingerprint,
    near_edited, near_next. The next text is that of the next smaller key
    (after the last: of the first); with one row it is its own. Null texts are
    empty. Texts are dealt out once, by blocks of keys, and then read in order.
    """
    rows = in_order(df, key, text)
    dealt = rows.repartition("block").sortWithinPartitions("block", "copy", F.col("k").desc_nulls_last(), "t")
    ddl = (
        f"`{key}` long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    out = StructType(_parse_datatype_string(ddl).fields)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        held, size = None, 0

        def pair(now, then) -> None:
            (_, k, t, f), (_, _, u, g) = now, then
            e = edited(t, u)
            fe = fingerprint(e)
            made.append((k, len(t), e, written(f), written(fe), likeness(f, fe), likeness(f, g)))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*made, strict=True))
            made.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for block, k, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                t = t.as_py()
                now = (block, k, t, fingerprint(t))
                if held and held[0] == block:
                    pair(held, now)
                    size += len(t)
                    if size > CHUNK_CHARS:
                        yield flush()
                        size = 0
                held = now
        if made:
            yield flush()

    return dealt.mapInArrow(run, out)
