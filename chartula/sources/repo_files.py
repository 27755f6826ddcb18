"""Python source files of checked-out repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_FILE_BYTES = 500_000
# Directories and files left out of a repository scan.
EXCLUDED_DIRS = [
    "tests", "test", "__pycache__", ".git", "venv", "env",
    "node_modules", "build", "dist", ".pytest_cache", "docs",
    "examples", "example", "demo", "benchmark",
]
EXCLUDED_FILES = ["setup.py", "conftest.py"]


def read_repositories(spark: SparkSession, root: str) -> DataFrame:
    """``(repo, path, content)`` for every wanted file under ``root/<repo>/``.

    Path and size are tested on file metadata, before any content is read.  Content is NULL
    where the bytes are not UTF-8.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.py")
        .load(root)
    )
    inside = F.substring_index(F.col("path"), root.rstrip("/") + "/", -1)
    files = files.withColumn("repo", F.substring_index(inside, "/", 1)).withColumn(
        "_inside", F.substring(inside, F.length(F.substring_index(inside, "/", 1)) + 2, F.length(inside))
    )
    text = F.col("content").cast("string")
    return wanted_files(files, "_inside", "length").select(
        "repo", F.col("_inside").alias("path"), F.when(F.is_valid_utf8(text), text).alias("content")
    )


def wanted_files(files: DataFrame, path_col: str = "path", size_col: str = "size") -> DataFrame:
    parts = F.split(F.col(path_col), "/")
    name = F.element_at(parts, -1)
    folders = F.slice(parts, 1, F.size(parts) - 1)
    excluded = F.exists(folders, lambda d: d.isin(EXCLUDED_DIRS) | d.startswith("."))
    return files.filter(
        name.endswith(".py")
        & ~name.startswith("test_")
        & ~name.isin(EXCLUDED_FILES)
        & (F.col(size_col) < MAX_FILE_BYTES)
        & ~excluded
    )
