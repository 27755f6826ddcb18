"""Readers for landed pages and sitemaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartula.schemas import RAW_PAGES


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Landed pages ``(url, markdown)`` with a non-empty body from parquet, json or text files.

    For text every file is one page and its path is the url.
    """
    if fmt == "text":
        pages = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
        pages = pages.select(F.input_file_name().alias("url"), F.col("value").alias("markdown"))
    else:
        pages = spark.read.format(fmt).schema(RAW_PAGES).load(path)
    return pages.filter(F.col("markdown").isNotNull() & (F.col("markdown") != ""))


def read_sitemaps(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return sitemap_urls(files.select(F.input_file_name().alias("path"), F.col("value").alias("xml")))


def sitemap_urls(sitemaps: DataFrame) -> DataFrame:
    """``(path, position, url)`` for every ``loc`` in any namespace; malformed files give no rows."""
    parsed = F.from_xml(
        F.col("xml"), "_broken string", {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"}
    )
    sound = sitemaps.select(
        "path", F.when(parsed["_broken"].isNull() & parsed.isNotNull(), F.col("xml")).alias("xml")
    ).filter(F.col("xml").isNotNull())
    locs = F.xpath(F.col("xml"), F.lit('//*[local-name()="loc"]/text()'))
    return sound.select("path", F.posexplode(locs).alias("position", "url"))
