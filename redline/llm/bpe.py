"""Byte-level BPE encoding and decoding by a two-tier lookup.

Tier one: a minimal perfect hash (hash and displace) resolves a whole pre-token
that the vocabulary holds. Tier two: any other pre-token is merged, lowest rank
and then leftmost pair first, by a heap over a linked list of its bytes; the
rank of a candidate pair comes from the same perfect hash.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F

from redline.llm.common import Memo, map_texts, without

#: Pre-tokens met twice whose ids a worker remembers, those met once, and ranks of pairs; about 200 bytes each.
OFTEN, ONCE, PAIRS = 400_000, 250_000, 250_000


@dataclass
class Vocabulary:
    """A rank file behind a minimal perfect hash; at most ``LIMIT`` entries, as it is broadcast."""

    displacement: list[int]
    keys: list[bytes]
    ids: list[int]
    pattern: str

    LIMIT = 2_000_000

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        """From lines of a base64 token and its rank; read on the driver alone."""
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        return cls.build({base64.b64decode(token): int(rank) for token, rank in pairs}, pattern)

    @classmethod
    def build(cls, ranks: dict[bytes, int], pattern: str) -> Vocabulary:
        n = len(ranks)
        if not 256 <= n <= cls.LIMIT:
            raise ValueError(f"{n} tokens; a byte-level vocabulary to broadcast has 256 to {cls.LIMIT}")
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"bytes without a token: {missing[:5]}")
        cells = max(1, n // 4)
        by_cell: list[list[bytes]] = [[] for _ in range(cells)]
        for key in ranks:
            by_cell[xxhash.xxh3_64_intdigest(key) % cells].append(key)
        displacement, slots = [0] * cells, [None] * n
        order = sorted(range(cells), key=lambda c: -len(by_cell[c]))
        free = iter(range(n))
        for cell in order:
            members = by_cell[cell]
            if len(members) == 1:  # put where there is room; a negative number names the slot
                slot = next(s for s in free if slots[s] is None)
                displacement[cell], slots[slot] = -slot - 1, members[0]
            elif members:
                hashes, d = [xxhash.xxh3_64_intdigest(k) for k in members], 0
                while True:
                    at = {_slot(h, d, n) for h in hashes}
                    if len(at) == len(members) and all(slots[s] is None for s in at):
                        break
                    d += 1
                displacement[cell] = d
                for key, h in zip(members, hashes, strict=True):
                    slots[_slot(h, d, n)] = key
        return cls(displacement, slots, [ranks[k] for k in slots], pattern)

    def rank(self, token: bytes) -> int:
        """The token's rank, or -1."""
        h = xxhash.xxh3_64_intdigest(token)
        d = self.displacement[h % len(self.displacement)]
        slot = -d - 1 if d < 0 else _slot(h, d, len(self.keys))
        return self.ids[slot] if self.keys[slot] == token else -1

    def encode_piece(self, piece: bytes, rank: Callable[[bytes], int] | None = None) -> list[int]:
        """The ids of one pre-token; ``rank`` may remember what self.rank gave."""
        whole = self.rank(piece)
        return [whole] if whole >= 0 else self._merge(piece, rank or self.rank)

    def _merge(self, piece: bytes, rank: Callable[[bytes], int]) -> list[int]:
        n = len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ids = [rank(piece[i : i + 1]) for i in range(n)]
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) >= 0]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            merged, i, end = pop(heap)
            j = after[i]
            if j < 0 or j >= n or after[j] != end:  # one of the two has been merged since
                continue
            ids[i], after[i], after[j] = merged, end, -1
            if end < n:
                before[end] = i
                if (r := rank(piece[i : after[end]])) >= 0:
                    push(heap, (r, i, after[end]))
            if (h := before[i]) >= 0 and (r := rank(piece[h:end])) >= 0:
                push(heap, (r, h, end))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def tokens(self) -> dict[int, bytes]:
        return dict(zip(self.ids, self.keys, strict=True))


class Seen(dict):
    """Keeps what ``once`` made from the second time that it is asked for, so that rare keys evict no common one."""

    def __init__(self, once: Memo, most: int):
        super().__init__()
        self.once, self.most = once, most

    def __missing__(self, key):
        before, value = key in self.once, self.once[key]
        if before:
            if len(self) >= self.most:
                self.clear()
            self[key] = self.once.pop(key)
        return value


def _slot(h: int, d: int, n: int) -> int:
    return ((((h ^ (d * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF) >> 33) % n


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with ``out``, the ids of its whole text as array<int>.

    A null or empty text has no ids. A column that is called ``out`` already is
    replaced. Special tokens' strings are ordinary text.
    """
    return _mapped(df, vocabulary, text, f"`{out}` array<int>", decoded=False)


def encode_decode(
    df: DataFrame, vocabulary: Vocabulary, text: str = "text", out: str = "ids", decoded: str = "decoded"
) -> DataFrame:
    """As ``encode``, and ``decoded``: the bytes that the ids stand for, looked up id by id."""
    return _mapped(df, vocabulary, text, f"`{out}` array<int>, `{decoded}` binary", decoded=True)


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``, the bytes of an array of ids; null for null, an error for an unknown id."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    rest = without(df, out)
    schema = StructType([*(df.schema[c] for c in rest), StructField(out, BinaryType())])
    at = rest.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shared.value.tokens()
        for batch in batches:
            made = [None if x is None else b"".join(map(token.__getitem__, x)) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=schema.names)

    return df.select(*[F.col(f"`{c}`") for c in rest]).mapInArrow(run, schema)


def _mapped(df: DataFrame, vocabulary: Vocabulary, text: str, schema: str, decoded: bool) -> DataFrame:
    made = {c.split("`")[1] for c in schema.split(", ")}
    shared, state = df.sparkSession.sparkContext.broadcast(vocabulary), {}

    def kernel(texts: list[str | None]) -> list[pa.Array]:
        if not state:
            words = shared.value
            state["find"] = regex.compile(words.pattern).findall
            rank = Memo(words.rank, PAIRS).__getitem__
            once = Memo(lambda p: array("i", words.encode_piece(p.encode(), rank)).tobytes(), ONCE)
            state["memo"] = Seen(once, OFTEN)
            state["tokens"] = words.tokens()
        find, ids_of, token = state["find"], state["memo"].__getitem__, state["tokens"].__getitem__
        each = [np.frombuffer(b"".join(map(ids_of, find(t or ""))), np.int32) for t in texts]
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in each]))).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(each)))
        return [ids] + ([pa.array([b"".join(map(token, x.tolist())) for x in each], pa.binary())] if decoded else [])

    return map_texts(df, text, schema, kernel, without(df, *made))
