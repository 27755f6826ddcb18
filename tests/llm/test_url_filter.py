"""URL rules against trying every rule on every URL."""

import itertools

import pytest

from chartula.llm import url_filter
from chartula.llm.url_filter import Rule

RULES = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"), Rule("block", "a-b.org", "/x1"), Rule("allow", "a-b.org", "/x1/y"), Rule("block", "dé.com", ""), Rule("block", "com", "/?"), Rule("allow", "", "/only")]
HOSTS = ["net", "x.net", "EXAMPLE.net", "www.example.net", "notexample.net", "example.com", "a-b.org", "sub.a-b.org", "dé.com", "", "net.", "user@x.net:80", "a\nb.net", "net\n", "\n.example.net"]
PATHS = ["", "/", "/en/", "/en", "/de/x", "/fr/?q", "?/en/", "#/en/", "/x1", "/x12", "/x1/y/z", "/only", "/EN/"]


def brute(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut], rest[cut:].split("?")[0].split("#")[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = min(fits, key=lambda r: (-len(r.name), r.name), default=None)
    return host, path, best and best.name, best.verdict if best else "allow"


@pytest.mark.parametrize("most", [100_000, 2])
def test_every_rule_on_every_url(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "INDEX_RULES", most)
    urls = [f"http://{h}{p}" for h, p in itertools.product(HOSTS, PATHS)] + [None, "", "net/", "//net/", "a://b://net/", "https://x.net/a\nb"]
    table = spark.createDataFrame([(n, u, "x", "y") for n, u in enumerate(urls)] + [(None, urls[0], "x", "y")], "page_id long, url string, host string, rule string")
    out = url_filter.judge_urls(table, RULES).collect()
    assert len(out) == len(urls) + 1
    for r in out:
        url = urls[r.page_id or 0]
        assert (r.host, r.path, r.rule, r.verdict) == brute(url), url
    assert url_filter.judge_urls(table.limit(0), RULES).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(table, []).collect()} == {"allow"}
