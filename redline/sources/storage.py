"""Uploads and saved reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from redline.schemas import REPORT


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """task_id, role, suffix, content of files named {task}-{role}{suffix}."""
    name = F.col("_metadata.file_name")
    pattern = r"^(.*)-([^-.]+)(\.[^.]*)$"
    part = lambda i: F.regexp_extract(name, pattern, i)
    files = spark.read.format("binaryFile").load(path)
    return files.select(part(1).alias("task_id"), part(2).alias("role"), part(3).alias("suffix"), "content").where("role <> ''")


def save_upload(spark: SparkSession, folder: str, task_id: str, role: str, suffix: str, content: bytes) -> str:
    """One upload as {task}-{role}{suffix} in ``folder``, in whatever store that is; the path."""
    if not suffix.startswith("."):
        raise ValueError("a suffix begins with a dot")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{task_id}-{role}{suffix}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(content)
    finally:
        out.close()
    return path.toString()


def find_upload(uploads: DataFrame, task_id: str, role: str) -> DataFrame:
    """The first upload (by suffix) of a task's role, if there is one."""
    return uploads.where((F.col("task_id") == task_id) & (F.col("role") == role)).orderBy("suffix").limit(1)


def write_reports(documents: DataFrame, path: str) -> None:
    """Report documents (see plans.compare.report_documents) as JSON lines."""
    documents.select(*StructType.fromDDL(REPORT).names).write.mode("append").json(path)


def read_report(spark: SparkSession, path: str, pair_id: int | None = None) -> DataFrame:
    """Saved reports, or those of one pair: no row if there is none."""
    saved = spark.read.schema(REPORT).json(path)
    return saved if pair_id is None else saved.where(F.col("pair_id") == pair_id)
