import datetime
import json
from pathlib import Path

from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartula.functions import markup
from chartula.sources import pages, repo_files, tables, wiki


def test_sitemaps(spark, tmp_path):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    files = {
        "a.xml": f"<urlset {ns}><url><loc>https://x/1</loc></url><url><loc>https://x/2?a=1&amp;b=2</loc></url></urlset>",
        "b.xml": "<urlset><url><loc>https://y/1</loc></url></urlset>",
        "c.xml": f'<?xml version="1.0"?><sitemapindex {ns}><sitemap><loc>https://z/s.xml</loc></sitemap></sitemapindex>',
        "d.xml": "<urlset><url><loc>https://broken/1</loc></url>",
        "e.xml": "not xml",
    }
    for name, body in files.items():
        (tmp_path / name).write_text(body)
    got = sorted(r.url for r in pages.read_sitemaps(spark, str(tmp_path)).collect())
    assert got == ["https://x/1", "https://x/2?a=1&b=2", "https://y/1", "https://z/s.xml"]


def test_landed_pages(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"url": "u", "markdown": "text"}\n{"url": "v", "markdown": ""}\n{"url": "w"}\n')
    assert [r.url for r in pages.read_pages(spark, str(tmp_path / "p.json"), "json").collect()] == ["u"]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "one.txt").write_text("a\nb")
    assert [r.markdown for r in pages.read_pages(spark, str(tmp_path / "t"), "text").collect()] == ["a\nb"]


BODY = {
    "type": "doc",
    "content": [
        {"type": "heading", "attrs": {"level": 2}, "content": [{"type": "text", "text": "Title"}]},
        {
            "type": "paragraph",
            "content": [
                {"type": "text", "text": "see "},
                {"type": "text", "text": "bold", "marks": [{"type": "strong"}]},
                {"type": "text", "text": " link", "marks": [{"type": "link", "attrs": {"href": "https://h"}}]},
            ],
        },
        {"type": "codeBlock", "attrs": {"language": "python"}, "content": [{"type": "text", "text": "x = 1"}]},
        {
            "type": "bulletList",
            "content": [
                {"type": "listItem", "content": [{"type": "paragraph", "content": [{"type": "text", "text": t}]}]}
                for t in ("one", "two")
            ],
        },
        {"type": "rule"},
    ],
}


def test_cloud_page(spark):
    page = {
        "id": "12", "title": "T", "spaceId": "99", "space": {"key": "ENG"}, "parentId": "7", "createdAt": "2024-01-01",
        "body": {"atlas_doc_format": {"value": json.dumps(BODY)}},
        "version": {"by": {"displayName": "Ann"}, "createdAt": "2024-02-02"},
        "labels": {"results": [{"name": "a"}, {}]},
        "_links": {"base": "https://w", "webui": "/p/12"},
    }
    bare = {"id": 13, "spaceId": "S"}
    frame = spark.createDataFrame([(json.dumps(page),), (json.dumps(bare),)], "json string")
    full, empty = wiki.wiki_pages(frame, "cloud").orderBy("page_id").collect()
    assert full.markdown_content == "## Title\n\nsee **bold**[ link](https://h)\n\n```python\nx = 1\n```\n\n- one\n- two\n\n---"
    assert (full.space_key, full.url, full.author, full.last_modified, full.labels, full.parent_page_id) == (
        "ENG", "https://w/p/12", "Ann", "2024-02-02", ["a", ""], "7",
    )
    assert (empty.page_id, empty.space_key, empty.url, empty.labels, empty.parent_page_id) == ("13", "S", "", [], None)


def test_on_premises_page(spark):
    html = (
        "<h1>Top</h1><p>Some <strong>bold</strong> &amp; <a href=\"https://h\">here</a></p><ul><li>one</li><li>two</li></ul>"
        '<ac:structured-macro ac:name="code"><ac:parameter ac:name="language">sql</ac:parameter>'
        "<ac:plain-text-body><![CDATA[SELECT 1]]></ac:plain-text-body></ac:structured-macro>"
    )
    page = {
        "id": "5", "title": "T", "space": {"key": "K"}, "body": {"storage": {"value": html}},
        "version": {"by": {"displayName": "Bo"}, "when": "2024-03-03"},
        "metadata": {"labels": {"results": [{"name": "x"}]}}, "ancestors": [{"id": "1"}, {"id": "2"}],
        "_links": {"webui": "/p/5"},
    }
    row = wiki.wiki_pages(spark.createDataFrame([(json.dumps(page),)], "json string"), "on_premises").first()
    assert (row.created, row.last_modified, row.parent_page_id, row.url, row.labels) == ("2024-03-03", "2024-03-03", "2", "/p/5", ["x"])
    for part in ("# Top", "Some **bold** & [here](https://h)", "- one\n- two", "```sql\nSELECT 1\n```"):
        assert part in row.markdown_content, (part, row.markdown_content)
    assert "\n\n\n" not in row.markdown_content


def test_blocks_of_document_json(spark):
    frame = spark.createDataFrame([(json.dumps(BODY),), ("not json",), (None,)], "b string")
    rows = frame.select(F.explode(markup.document_blocks(F.col("b"))).alias("x")).select("x.*").collect()
    assert [(r.block_type, r.level, r.text) for r in rows][:3] == [
        ("heading", 2, "Title"), ("paragraph", None, "see **bold**[ link](https://h)"), ("code", None, "x = 1"),
    ]
    assert len(rows) == 6


def test_repository_files(spark, tmp_path):
    names = ["app/a.py", "app/test_a.py", "setup.py", "tests/b.py", ".git/c.py", "app/.x/d.py", "conftest.py", "app/readme.md", "docs/e.py", "f.py"]
    for name in names:
        target = tmp_path / "shop" / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text("x = 1\n")
    (tmp_path / "shop" / "big.py").write_text("#" * 500_000)
    (tmp_path / "shop" / "latin.py").write_bytes(b"x = '\xe9'\n")
    rows = {r.path: (r.repo, r.content) for r in repo_files.read_repositories(spark, str(tmp_path)).collect()}
    assert rows == {"app/a.py": ("shop", "x = 1\n"), "f.py": ("shop", "x = 1\n"), "latin.py": ("shop", None)}


def test_publication(spark, tmp_path):
    root = str(tmp_path / "table")
    schema = T._parse_datatype_string("url string, chunk_number int, content string")
    assert tables.current(spark, root, schema) is None
    tables.create(spark, root, schema)
    assert tables.current(spark, root, schema).count() == 0
    tables.publish(spark.createDataFrame([("u", 0, "old"), ("v", 0, "keep"), (None, 1, "no key")], schema), root)
    new = spark.createDataFrame([("u", 0, "a", 1), ("u", 0, "b", 2), ("u", 1, "c", 3)], "url string, chunk_number int, content string, o int")
    tables.publish(tables.replace_by_url(tables.current(spark, root, schema), new, order="o"), root)
    rows = {(r.url, r.chunk_number, r.content) for r in tables.current(spark, root, schema).collect()}
    assert rows == {("v", 0, "keep"), ("u", 0, "b"), ("u", 1, "c")}
    tables.create(spark, root, schema)
    assert tables.current(spark, root, schema).count() == 3


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    root = str(tmp_path / "table")
    schema = T._parse_datatype_string("url string, content string")
    tables.publish(spark.createDataFrame([(f"u{n}", "old") for n in range(200)], schema), root, buckets=8)

    def files():
        return {str(f.relative_to(root)): f.stat().st_mtime_ns for f in Path(root).rglob("*.parquet")}

    before = files()
    assert {f.split("/")[0] for f in before} == {f"bucket={n}" for n in range(8)}
    touched = tables.buckets_of(spark.createDataFrame([("u3",)], "url string"), buckets=8)
    stored = tables.current(spark, root, schema, touched)
    scan = stored._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in scan.split("PartitionFilters: [")[1].split("]")[0]
    lost = stored.count()
    assert 0 < lost < 200 and len(touched) == 1
    changed = stored.withColumn("content", F.when(F.col("url") == "u3", "new").otherwise(F.col("content")))
    tables.publish(changed, root, touched, buckets=8)
    after = files()
    assert {f for f in before if after.get(f) == before[f]} == {f for f in before if not f.startswith(f"bucket={touched[0]}/")}
    rows = {r.url: r.content for r in tables.current(spark, root, schema).collect()}
    assert rows == {f"u{n}": "new" if n == 3 else "old" for n in range(200)}
    # A bucket that loses all rows is emptied, though nothing is written into it but its marker.
    tables.publish(tables.current(spark, root, schema).limit(0), root, touched, buckets=8)
    assert tables.current(spark, root, schema).count() == 200 - lost


def test_source_upsert_keeps_creation(spark):
    old = datetime.datetime(2024, 1, 1)
    schema = "source_id string, summary string, total_words long, created_at timestamp, updated_at timestamp"
    existing = spark.createDataFrame([("a", "x", 5, old, old), ("b", "y", 6, old, old)], schema)
    updates = spark.createDataFrame([("a", "z", 9), ("c", "n", 1)], "source_id string, summary string, total_words long")
    now = F.lit("2025-05-05").cast("timestamp")
    rows = {r.source_id: r for r in tables.upsert_sources(existing, updates, now).collect()}
    assert (rows["a"].summary, rows["a"].total_words, rows["a"].created_at.year, rows["a"].updated_at.year) == ("z", 9, 2024, 2025)
    assert (rows["b"].summary, rows["b"].updated_at.year, rows["c"].created_at.year) == ("y", 2024, 2025)


def test_wiki_files_become_a_snapshot(spark, tmp_path):
    page = {"id": "7", "title": "T", "space": {"key": "K"}, "body": {"storage": {"value": "<p>Hello</p>"}}, "version": {"by": {"displayName": "ann"}, "when": "2024"},
            "metadata": {"labels": {"results": [{"name": "x"}, {"name": None}]}}, "ancestors": [{"id": "1"}, {"id": "2"}], "_links": {"base": "https://h", "webui": "/p/7"}}
    (tmp_path / "a.json").write_text(json.dumps(page) + "\n")
    (row,) = wiki.snapshot_rows(wiki.read_wiki_json(spark, str(tmp_path), "on_premises")).collect()
    assert (row.url, row.source_id, row.markdown, row.last_modified) == ("https://h/p/7", "confluence:K", "Hello", "2024")
    assert row.meta.asDict() == {
        "source_type": "confluence", "space_key": "K", "page_id": "7", "page_title": "T", "labels": ["x", ""], "author": "ann", "last_modified": "2024", "parent_page_id": "2",
    }
