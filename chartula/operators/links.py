"""Page links and bounded-depth reachability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartula.functions import urls
from chartula.operators.joins import salted_join
from chartula.session import append_bucketed, bucketed, cut_lineage

#: Parts of a page's links.
EDGE_SALTS = 8


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def outlinks(pages: DataFrame, *, html_col: str = "html") -> DataFrame:
    """One row per link: ``(url, position, href, target, internal)`` with defragmented targets."""
    rows = pages.select("url", F.posexplode(hrefs(F.col(html_col))).alias("position", "href"))
    target = urls.defragment(urls.resolve_link(F.col("url"), F.col("href")))
    return rows.withColumn("target", target).withColumn(
        "internal", urls.is_internal(F.col("url"), F.col("href"))
    )


def link_counts(pages: DataFrame, *, html_col: str = "html") -> DataFrame:
    """Internal and external links per page, counted inside the row."""
    flags = F.transform(hrefs(F.col(html_col)), lambda h: urls.is_internal(F.col("url"), h))
    rows = pages.select("url", flags.alias("_flags"))
    return rows.select(
        "url",
        F.size(F.filter("_flags", lambda f: f)).alias("internal"),
        F.size(F.filter("_flags", lambda f: ~f)).alias("external"),
    )


def _followed(sources: DataFrame, edges: DataFrame) -> DataFrame:
    """Pages linked from ``sources(url)``; only these move to the bucketed ``edges(src, salt, dst)``."""
    spread = sources.select(F.col("url").alias("src"), F.explode(F.sequence(F.lit(0), F.lit(EDGE_SALTS - 1))).alias("salt"))
    return edges.join(spread, ["src", "salt"]).select(F.col("dst").alias("url")).distinct()


def reachable(links: DataFrame, pages: DataFrame, starts: DataFrame, max_depth: int = 3) -> DataFrame:
    """Level-by-level visit over ``links(src, dst)``, levels 0 to ``max_depth - 1``.

    ``pages(url, ok)`` tells which pages can be read; a page that cannot, or is unknown,
    counts as visited but gives no links.  Returns ``(url, depth, ok)``.

    The links are shuffled once, into buckets by page (a page with very many links lies in several); visited pages
    lie in buckets of their own, which each level adds to.  From level to level only the frontier moves.
    """
    spark = links.sparkSession
    edges = links.select(urls.defragment(F.col("src")).alias("src"), urls.defragment(F.col("dst")).alias("dst"))
    edge_table = bucketed(edges.withColumn("salt", F.pmod(F.xxhash64("dst"), F.lit(EDGE_SALTS)).cast("int")), ["src", "salt"], "edges")
    good_table = bucketed(pages.filter("ok").select(urls.defragment(F.col("url")).alias("url")).distinct(), ["url"], "pages")
    first = starts.select(urls.defragment(F.col("url")).alias("url")).distinct().withColumn("depth", F.lit(0))
    visited_table = bucketed(first, ["url"], "visited")
    good = spark.table(good_table)
    for depth in range(1, max_depth):
        visited = spark.table(visited_table)
        sources = visited.filter(F.col("depth") == depth - 1).join(good, "url", "left_semi")
        fresh = _followed(sources, spark.table(edge_table)).join(visited, "url", "left_anti")
        append_bucketed(fresh.withColumn("depth", F.lit(depth)), ["url"], visited_table)
        if spark.table(visited_table).filter(F.col("depth") == depth).isEmpty():
            break
    found = spark.table(visited_table).join(good.withColumn("ok", F.lit(True)), "url", "left")
    found = cut_lineage(found.withColumn("ok", F.coalesce("ok", F.lit(False))))
    for name in (edge_table, good_table, visited_table):
        spark.sql(f"DROP TABLE {name}")
    return found


def page_tree(
    tree: DataFrame,
    pages: DataFrame,
    root_id: str,
    *,
    max_depth: int,
    max_pages: int | None = None,
) -> DataFrame:
    """Breadth-first walk over ``tree(parent, child, ord)``, depth limit inclusive.

    At most ``max_pages`` readable pages are taken in breadth-first order; a page that cannot
    be read is reported but its children are not followed.  Returns ``(page_id, depth,
    order_key, ok)``; sorting by depth and order key gives the visiting order.
    """
    spark = tree.sparkSession
    good = pages.filter("ok").select("page_id").distinct().withColumn("ok", F.lit(True))
    level = spark.range(1).select(
        F.lit(root_id).alias("page_id"), F.array().cast("array<int>").alias("order_key")
    )
    visited: DataFrame | None = None
    total = 0
    for depth in range(max_depth + 1):
        level = level.join(good, "page_id", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
        level = cut_lineage(level.withColumn("depth", F.lit(depth)))
        taken = level.filter("ok").count()
        if max_pages is not None and taken >= max_pages - total:
            # Only the level that reaches the cap is ordered; it ends with the last page taken.
            taken = max_pages - total
            last = level.filter("ok").orderBy("order_key").limit(taken).agg(F.max("order_key")).first()[0]
            bound = F.array(*map(F.lit, last or [])).cast("array<int>")
            level = level.filter(F.col("order_key") <= bound)
        visited = level if visited is None else visited.unionByName(level)
        total += taken
        if total == max_pages or taken == 0 or depth == max_depth:
            break
        parents = level.filter("ok").select(F.col("page_id").alias("parent"), "order_key")
        children = salted_join(tree, parents, ["parent"], salt_on=["child"])
        key = F.array_append(F.col("order_key"), F.col("ord").cast("int"))
        children = children.groupBy(F.col("child").alias("page_id")).agg(F.min(key).alias("order_key"))
        level = children.join(visited, "page_id", "left_anti")
    assert visited is not None
    return visited.select("page_id", "depth", "order_key", "ok")
