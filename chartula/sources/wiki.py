"""Wiki page JSON, cloud and on-premises layouts, to one page schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartula.functions import markup

# Fixed value: how wiki rows are told from web rows.
SOURCE_TYPE = "confluence"

CLOUD = """struct<id: string, title: string, spaceId: string, space: struct<key: string>,
    parentId: string, createdAt: string,
    body: struct<atlas_doc_format: struct<value: string>>,
    version: struct<by: struct<displayName: string>, createdAt: string>,
    labels: struct<results: array<struct<name: string>>>,
    _links: struct<base: string, webui: string>>"""

ON_PREMISES = """struct<id: string, title: string, space: struct<key: string>,
    body: struct<storage: struct<value: string>>,
    version: struct<by: struct<displayName: string>, when: string>,
    metadata: struct<labels: struct<results: array<struct<name: string>>>>,
    ancestors: array<struct<id: string>>,
    _links: struct<base: string, webui: string>>"""


def read_wiki_json(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """One JSON page per line."""
    lines = spark.read.text(path, recursiveFileLookup=True).withColumnRenamed("value", "json")
    return wiki_pages(lines, layout)


def wiki_pages(lines: DataFrame, layout: str) -> DataFrame:
    if layout == "cloud":
        return _cloud(lines)
    if layout == "on_premises":
        return _on_premises(lines)
    raise ValueError(f"unknown layout {layout!r}")


def snapshot_rows(pages: DataFrame) -> DataFrame:
    """Wiki pages as a snapshot for the synchronisation: ``(url, source_id, markdown, last_modified, meta)``.

    ``meta`` goes into the metadata of every chunk of the page (``sync(..., meta=F.col("meta"))``).
    """
    meta = F.struct(
        F.lit(SOURCE_TYPE).alias("source_type"),
        "space_key",
        "page_id",
        F.col("title").alias("page_title"),
        "labels",
        "author",
        "last_modified",
        "parent_page_id",
    )
    return pages.select(
        "url",
        F.concat(F.lit(f"{SOURCE_TYPE}:"), "space_key").alias("source_id"),
        F.col("markdown_content").alias("markdown"),
        F.coalesce("last_modified", F.lit("")).alias("last_modified"),
        meta.alias("meta"),
    )


def _labels(results: Column) -> Column:
    names = F.transform(results, lambda x: F.coalesce(x["name"], F.lit("")))
    return F.coalesce(names, F.array().cast("array<string>"))


def _url(links: Column) -> Column:
    return F.concat(F.coalesce(links["base"], F.lit("")), F.coalesce(links["webui"], F.lit("")))


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _cloud(lines: DataFrame) -> DataFrame:
    page = F.col("_page")
    return lines.select(F.from_json("json", CLOUD).alias("_page")).select(
        page["id"].alias("page_id"),
        _text(page["title"]).alias("title"),
        _text(F.coalesce(page["space"]["key"], page["spaceId"])).alias("space_key"),
        _url(page["_links"]).alias("url"),
        markup.document_markdown(page["body"]["atlas_doc_format"]["value"]).alias("markdown_content"),
        page["version"]["by"]["displayName"].alias("author"),
        page["createdAt"].alias("created"),
        page["version"]["createdAt"].alias("last_modified"),
        _labels(page["labels"]["results"]).alias("labels"),
        F.nullif(page["parentId"], F.lit("")).alias("parent_page_id"),
    )


def _on_premises(lines: DataFrame) -> DataFrame:
    page = F.col("_page")
    return lines.select(F.from_json("json", ON_PREMISES).alias("_page")).select(
        page["id"].alias("page_id"),
        _text(page["title"]).alias("title"),
        _text(page["space"]["key"]).alias("space_key"),
        _url(page["_links"]).alias("url"),
        markup.storage_markdown(_text(page["body"]["storage"]["value"])).alias("markdown_content"),
        page["version"]["by"]["displayName"].alias("author"),
        page["version"]["when"].alias("created"),
        page["version"]["when"].alias("last_modified"),
        _labels(page["metadata"]["labels"]["results"]).alias("labels"),
        F.try_element_at(page["ancestors"], F.lit(-1))["id"].alias("parent_page_id"),
    )
