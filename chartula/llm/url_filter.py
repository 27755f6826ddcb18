"""URL filters: pattern rules found by their rarest literal token, then matched by regular expression.

A rule's pattern is a host and a path prefix (``net/``, ``example.com/de/``). Its literal tokens are the
runs of ASCII letters and digits in it. The tokens of the rules are counted over all URLs in Spark, each
rule is filed under its rarest one, and a URL's own tokens fetch the few rules whose regular expression
has to run. The index is shipped to the tasks in parts of at most ``INDEX_RULES`` rules; each part is one more
row-local step that keeps the better of its own and the earlier rule, so no URL is shuffled for any rule set.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INDEX_RULES = 100_000
_TOKEN = re.compile("[0-9A-Za-z]+")
SCHEMA = "page_id long, host string, path string, rule string, verdict string"


class Rule(NamedTuple):
    """``host`` is a domain and covers its subdomains, ``path`` the beginning of the URL's path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def patterns(self) -> tuple[str, str]:
        """For the whole host and for the beginning of the path; they may hold any character, line feeds too."""
        return rf"(?s:.*\.)?{re.escape(self.host)}", re.escape(self.path)

    @property
    def tokens(self) -> set[str]:
        # The last token of the path may go on in the URL, so only closed tokens are certain to occur.
        closed = [m.group() for m in _TOKEN.finditer(self.path) if m.end() < len(self.path)]
        return set(_TOKEN.findall(self.host)) | set(closed)


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased (else empty)."""
    rest = F.substring_index(F.substring_index(F.substring_index(_rest(url), "/", 1), "?", 1), "#", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(rest, upper, lower)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end (else empty)."""
    after = F.regexp_replace(_rest(url), "^[^/?#]*", "")
    return F.substring_index(F.substring_index(after, "?", 1), "#", 1)


def _rest(url: Column) -> Column:
    at = F.coalesce(F.locate("://", url), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def _parts(urls: DataFrame) -> DataFrame:
    return urls.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))


def _counter(wanted: list[str]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = set(wanted), Counter()
        for batch in batches:
            for host, path in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True):
                counts.update(known.intersection(_TOKEN.findall(f"{host}\n{path}")))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["token", "count"])

    return count


def rarest_tokens(urls: DataFrame, rules: list[Rule]) -> dict[str, list[Rule]]:
    """Rules by their rarest token in all ``urls``; a rule without a certain token stands under the empty one.

    A task sends one number for each rule token it saw, so a token of most URLs is no hot key.
    """
    wanted = sorted(set().union(*(rule.tokens for rule in rules)))
    parts, counts = _parts(urls), {}
    for at in range(0, len(wanted), INDEX_RULES):
        own = parts.mapInArrow(_counter(wanted[at : at + INDEX_RULES]), "token string, count long")
        counts |= dict(own.groupBy("token").agg(F.sum("count")).collect())
    index: dict[str, list[Rule]] = {}
    for rule in rules:
        token = min(rule.tokens, key=lambda t: (counts.get(t, 0), t), default="")
        index.setdefault(token, []).append(rule)
    return index


def _index_parts(index: dict[str, list[Rule]]) -> Iterator[dict[str, list[Rule]]]:
    part: dict[str, list[Rule]] = {}
    for n, (token, rule) in enumerate((t, r) for t, own in index.items() for r in own):
        if n and n % INDEX_RULES == 0:
            yield part
            part = {}
        part.setdefault(token, []).append(rule)
    yield part


def _matcher(part: dict[str, list[Rule]]):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = {t: [(len(r.name), r.name, r.verdict, *map(re.compile, r.patterns)) for r in own] for t, own in part.items()}
        always = compiled.get("", [])
        for batch in batches:
            rules, verdicts = batch.column("rule").to_pylist(), batch.column("verdict").to_pylist()
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
                best = (-len(rules[i]), rules[i]) if rules[i] is not None else (1, "")
                for token in {*_TOKEN.findall(host), *_TOKEN.findall(path), ""}:
                    for size, name, verdict, in_host, in_path in compiled.get(token, ()) if token else always:
                        if (-size, name) < best and in_host.fullmatch(host) and in_path.match(path):
                            best, rules[i], verdicts[i] = (-size, name), name, verdict
            yield batch.set_column(3, "rule", pa.array(rules, pa.string())).set_column(4, "verdict", pa.array(verdicts, pa.string()))

    return match


def judge_urls(urls: DataFrame, rules: Iterable[Rule], default: str = "allow") -> DataFrame:
    """One row per row of ``urls(page_id, url)``: page_id, host, path, rule, verdict.

    A rule fits its host and all subdomains if the URL's path starts with the rule's path (case counts in
    paths). Of the rules that fit the longest decides, then the first by name; without one, ``rule`` is
    null and ``default`` the verdict. A null URL, or one without ``://``, has an empty host and path.
    Repeated rows are judged each, an empty table gives no rows, other columns are not read.
    """
    rules = sorted(set(rules))
    found = _parts(urls).select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    for part in _index_parts(rarest_tokens(urls, rules)) if rules else ():
        found = found.mapInArrow(_matcher(part), SCHEMA)
    return found
