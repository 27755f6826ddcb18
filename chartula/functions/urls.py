"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?"


def netloc(url: Column) -> Column:
    """Authority part with port and user info; empty when the URL has none."""
    return F.regexp_extract(url, _SCHEME + r"//([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, _SCHEME + r"(?://[^/?#]*)?([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def source_id(url: Column) -> Column:
    host = netloc(url)
    return F.when(host != "", host).otherwise(path(url))


def defragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def url_class(url: Column) -> Column:
    return (
        F.when(url.endswith(".txt"), F.lit("text_file"))
        .when(url.endswith("sitemap.xml") | path(url).contains("sitemap"), F.lit("sitemap"))
        .otherwise(F.lit("webpage"))
    )


def wiki_page_id(url: Column) -> Column:
    """Page id from the known wiki URL layouts, NULL when none matches."""
    where = path(url)

    def first(text: Column, pattern: str) -> Column:
        return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))

    return F.coalesce(
        F.try_url_decode(first(query(url), r"(?:^|&)pageId=([^&]+)")),
        first(where, r"/pages/(\d+)"),
        first(where, r"/api/v[12]/pages/(\d+)"),
        first(where, r"/rest/api/content/(\d+)"),
    )


def repo_name(url: Column) -> Column:
    return F.replace(F.substring_index(url, "/", -1), F.lit(".git"), F.lit(""))


def resolve_link(base: Column, href: Column) -> Column:
    """Absolute form of a link found on page ``base`` (rooted and relative paths)."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([^/]*:)", 1), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("#") | href.startswith("?"), F.concat(root, path(base), href))
        .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), href))
    )


def is_internal(base: Column, href: Column) -> Column:
    """A link is internal when it has no authority of its own or shares the page's."""
    host = netloc(href)
    has_scheme = href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")
    return F.when(host != "", host == netloc(base)).otherwise(~has_scheme)
