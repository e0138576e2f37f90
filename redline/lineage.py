"""Cutting a plan where several later steps start from the same rows."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def materialized(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the folder that spark.checkpoint.dir names; a local one only where that is unset."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()
