"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Code points handled together by the numpy kernels; one longer text is handled alone.
CHUNK_CHARS = 1 << 19
#: Seconds that Py4J takes to tell the JVM which frames Python let go of.
WAIT = 1.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only where it is unset (tests, notebooks) one is made here."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut, in the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def clean_up(spark: SparkSession) -> None:
    """Shuffle files of steps that are checkpointed go from the disks now, not some half an hour later.

    Spark removes them once the driver's JVM has collected all that refers to
    them: first Python lets go of its frames (Py4J tells the JVM within a
    second), and plans go in the second collection.
    """
    spark.range(1).count()
    gc.collect()
    time.sleep(WAIT)
    for _ in range(2):
        spark.sparkContext._jvm.System.gc()
        time.sleep(WAIT / 3)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like ``wanted`` that no column of ``df`` has (case is ignored)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> list[str]:
    """The columns of ``df`` but those of these names (case is ignored, as Spark ignores it)."""
    gone = {name.lower() for name in names}
    return [c for c in df.columns if c.lower() not in gone]


def crc_fold(key: str, folds: int) -> Column:
    """crc32 of the decimal text of ``key``, modulo ``folds``; null keys fall in fold of the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % folds


def unit_hash(*cols: Column | str, seed: int = 0) -> Column:
    """A reproducible number in [0, 1) from the columns' values."""
    return (F.xxhash64(F.lit(seed), *cols).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))).cast("double")


def map_texts(
    df: DataFrame, text: str, schema: str, kernel: Callable[[list[str | None]], list[pa.Array]], keep: list[str]
) -> DataFrame:
    """Columns ``keep`` of ``df`` and those that ``kernel`` makes of bounded runs of whole texts.

    ``schema`` is the DDL of the kernel's columns. A run holds CHUNK_CHARS code
    points or one text, so a worker's memory follows the longest text alone.
    """
    from pyspark.sql.types import StructType, _parse_datatype_string

    if isinstance((kind := df.schema[text].dataType), StructType):
        raise TypeError(f"{text} must be a string, not {kind.simpleString()}")
    chosen = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(free_names(df, "__text")[0]))
    out = StructType([*(df.schema[c] for c in keep), *_parse_datatype_string(schema).fields])
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in runs(batch.column(n)):
                part = batch.slice(a, b - a)
                made = kernel(part.column(n).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *made], names=out.names)
            give_back()

    return chosen.mapInArrow(run, out)


def give_back() -> None:
    """Free memory goes back to the system: Python workers live on into later stages, and would keep their peak."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def runs(texts: pa.Array, most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold at most ``most`` bytes together, or one row."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, s in enumerate(sizes.tolist()):
        if total and total + s > most:
            yield start, i
            start, total = i, 0
        total += s
    if start < len(sizes):
        yield start, len(sizes)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of uint64 (multiply and xor-shift)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Memo(dict):
    """Remembers ``make(key)``; forgets all when it holds ``most`` entries, so its memory is bounded."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        self[key] = value = self.make(key)
        return value
