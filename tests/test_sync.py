from pathlib import Path

from pyspark.sql import functions as F

from chartula.operators import corpus_stats, links
from chartula.plans import sync as sy
from chartula.schemas import CHUNKS, CODE_EXAMPLES
from chartula.session import bucketed, cut_lineage
from chartula.sources import tables
from chartula.streaming.sync_stream import sync_stream

PAGES = "url string, source_id string, markdown string, last_modified string"


def snapshot(spark, rows):
    return spark.createDataFrame(rows, PAGES)


def first_load(spark):
    rows = [("a", "confluence:K", "text a", "1"), ("b", "confluence:K", "text b\n```py\n" + "x" * 1000 + "\n```", "1"), ("c", "confluence:K", "text c", "1"), ("d", "web", "text d", "")]
    result = sy.sync(snapshot(spark, rows), spark.createDataFrame([], CHUNKS), spark.createDataFrame([], CODE_EXAMPLES))
    return result.chunks, result.examples


def test_sync_states(spark):
    chunks, examples = first_load(spark)
    assert chunks.count() == 4 and examples.count() == 1
    later = snapshot(spark, [
        ("a", "confluence:K", "text a", "1"),
        ("b", "confluence:K", "changed", "2"),
        ("e", "confluence:K", " \n", "1"),
        ("f", "confluence:K", "new", "1"),
        ("d", "web", "text d", ""),
    ])
    result = sy.sync(later, chunks, examples, full=True)
    status = {r.url: r.status for r in result.outcomes.collect()}
    assert status == {"a": "skipped_unchanged", "b": "stored", "e": "skipped_empty", "f": "stored", "d": "stored"}
    assert [r.url for r in result.orphans.collect()] == ["c"]
    assert {r.url: r.content for r in result.chunks.collect()} == {"a": "text a", "b": "changed", "f": "new", "d": "text d"}
    assert result.examples.count() == 0
    row = result.summary.first()
    assert (row.pages_processed, row.pages_skipped_unchanged, row.pages_skipped_empty, row.orphaned_pages_deleted) == (3, 1, 1, 1)
    forced = sy.sync(later, chunks, examples, skip_unchanged=False)
    assert {r.status for r in forced.outcomes.filter("url = 'a'").collect()} == {"stored"}
    assert forced.chunks.filter("url = 'c'").count() == 1


def test_empty_snapshot_deletes_nothing(spark):
    chunks, examples = first_load(spark)
    result = sy.sync(snapshot(spark, []), chunks, examples, full=True)
    assert result.chunks.count() == 4 and result.orphans.count() == 0


def test_stream_equals_batches(spark, tmp_path):
    first = snapshot(spark, [("a", "s", "one", "1"), ("b", "s", "two", "1")])
    second = snapshot(spark, [("a", "s", "one more", "2"), ("c", "s", "three", "1")])
    folder = str(tmp_path / "in")
    roots = [str(tmp_path / "chunks"), str(tmp_path / "examples")]

    def run():
        sync_stream(spark, folder, first.schema, *roots, str(tmp_path / "state")).awaitTermination()
        return {(r.url, r.content) for r in tables.current(spark, roots[0], CHUNKS).collect()}

    first.coalesce(1).write.mode("append").parquet(folder)
    assert run() == {("a", "one"), ("b", "two")}
    second.coalesce(1).write.mode("append").parquet(folder)
    streamed = run()
    batch = sy.sync(first, spark.createDataFrame([], CHUNKS), spark.createDataFrame([], CODE_EXAMPLES))
    batch = sy.sync(second, batch.chunks, batch.examples)
    assert streamed == {(r.url, r.content) for r in batch.chunks.collect()} == {("a", "one more"), ("b", "two"), ("c", "three")}


def test_replayed_and_late_snapshots(spark, tmp_path):
    """Files that come again or late, in batches of their own, end where the batch form ends; unchanged pages touch no file."""
    batches = [
        [("a", "s", "one", "1"), ("b", "s", "two", "1"), ("n", "s", "unstamped", "")],
        [("a", "s", "one more", "2"), ("c", "s", "three", "1"), ("e", "s", " ", "1")],
        [("a", "s", "one more", "2"), ("b", "s", "two", "1")],  # replayed
        [("b", "s", "late", "0"), ("c", "s", "three", "1"), ("b", "s", "later", "00")],  # late
        [("n", "s", "unstamped too", None), ("a", "t", "same url, other source", "2")],
    ]
    folder, roots = str(tmp_path / "in"), [str(tmp_path / k) for k in ("chunks", "examples")]
    chunks, examples = spark.createDataFrame([], CHUNKS), spark.createDataFrame([], CODE_EXAMPLES)

    def files():
        return {str(f): f.stat().st_mtime_ns for f in Path(roots[0]).rglob("*.parquet")}

    for number, rows in enumerate(batches):
        before = files()
        snapshot(spark, rows).coalesce(1).write.mode("append").parquet(folder)
        sync_stream(spark, folder, snapshot(spark, []).schema, *roots, str(tmp_path / "state"), buckets=8).awaitTermination()
        result = sy.sync(snapshot(spark, rows), chunks, examples)
        chunks, examples = cut_lineage(result.chunks), cut_lineage(result.examples)
        streamed = sorted((r.id, r.source_id, r.content, r.metadata) for r in tables.current(spark, roots[0], CHUNKS).collect())
        assert streamed == sorted((r.id, r.source_id, r.content, r.metadata) for r in chunks.collect())
        if number == 2:
            assert files() == before
    assert {(r.url, r.content) for r in chunks.collect()} == {("a", "same url, other source"), ("b", "later"), ("c", "three"), ("n", "unstamped too")}


def test_migration_reports_on_the_new_table(spark, tmp_path):
    chunks, _ = first_load(spark)
    sources = chunks.select("source_id").distinct()
    report = sy.migrate(chunks, sources, lambda texts: [[1.0] * 8 for _ in texts], 8, str(tmp_path / "t")).first()
    assert report.total_documents == 4 and report.digests_match and not report.corruption_detected, report


def test_digests_find_lost_doubled_and_changed_rows(spark):
    rows = [(n, f"text {n}" if n % 7 else None) for n in range(60)]
    frame = spark.createDataFrame(rows, "id long, content string")

    def same(other):
        return corpus_stats.same_rows(frame, spark.createDataFrame(other, frame.schema)).first().digests_match

    assert same(rows[::-1])
    assert not same(rows[1:]) and not same(rows + rows[:1]) and not same(rows[1:] + [(0, "other")]) and not same([(1, None), (0, "text 1")] + rows[2:])
    assert corpus_stats.same_rows(frame.limit(0), frame.limit(0)).first().digests_match
    damaged = spark.createDataFrame(rows[1:] + rows[5:6] + [(100, "new")], frame.schema)
    parts = corpus_stats.differing_parts(frame, damaged, frame.columns, F.col("id") % 30)
    assert {tuple(r) for r in parts.collect()} == {(0, 2, 1), (5, 2, 3), (10, 2, 3)}


def test_reachability(spark):
    edges = [("s", "a"), ("a", "b#x"), ("b", "s"), ("b", "b"), ("b#y", "c"), ("c", "d"), ("s", "bad"), ("bad", "hidden"), ("s", "unknown")]
    ok = [(u, u != "bad") for u in ("s", "a", "b", "c", "d", "bad", "hidden")]
    frame, pages = spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(ok, "url string, ok boolean")
    starts = spark.createDataFrame([("s#top",), ("s",)], "url string")
    got = {r.url: (r.depth, r.ok) for r in links.reachable(frame, pages, starts, 4).collect()}
    assert got == {"s": (0, True), "a": (1, True), "bad": (1, False), "unknown": (1, False), "b": (2, True), "c": (3, True)}
    assert {r.url for r in links.reachable(frame, pages, starts, 1).collect()} == {"s"}


def test_reachability_moves_links_once(spark):
    """Deep walks over a hot page; from level to level the buckets of links and visited pages stay where they are."""
    edges = [(f"p{n}", f"p{n + 1}") for n in range(6)] + [("p2", f"x{n}") for n in range(500)] + [(f"x{n}", "p0") for n in range(500)]
    pages = spark.createDataFrame([(u, True) for u in {u for e in edges for u in e}], "url string, ok boolean")
    frame = spark.createDataFrame(edges, "src string, dst string")
    got = {r.url: r.depth for r in links.reachable(frame, pages, spark.createDataFrame([("p0",)], "url string"), 20).collect()}
    assert got == {f"p{n}": n for n in range(7)} | {f"x{n}": 3 for n in range(500)}
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith(("edges_", "visited_", "pages_"))]
    salted = frame.withColumn("salt", F.pmod(F.xxhash64("dst"), F.lit(links.EDGE_SALTS)).cast("int"))
    table = bucketed(salted, ["src", "salt"], "edges")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = links._followed(frame.select(F.col("src").alias("url")), spark.table(table))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql(f"DROP TABLE {table}")
    # One exchange for the frontier and one to make the pages distinct, none for the links.
    assert plan.count("Exchange hashpartitioning") == 2, plan


def test_page_tree_order_and_caps(spark):
    tree = spark.createDataFrame([("r", "a", 0), ("r", "b", 1), ("r", "x", 2), ("a", "c", 0), ("b", "c", 0), ("b", "d", 1), ("x", "e", 0), ("d", "r", 0)], "parent string, child string, ord int")
    pages = spark.createDataFrame([(p, p != "x") for p in "rabcdex"], "page_id string, ok boolean")

    def walk(depth, cap):
        rows = links.page_tree(tree, pages, "r", max_depth=depth, max_pages=cap)
        return [r.page_id for r in rows.orderBy("depth", "order_key").collect()]

    assert walk(5, 100) == ["r", "a", "b", "x", "c", "d"]
    assert walk(1, 100) == ["r", "a", "b", "x"]
    assert walk(5, 4) == ["r", "a", "b", "x", "c"]
    assert walk(0, 100) == ["r"]


def test_two_snapshots_in_one_trigger(spark, tmp_path):
    first = snapshot(spark, [("a", "s", "one", "1"), ("b", "s", "two", "1")])
    second = snapshot(spark, [("a", "s", "one more", "2"), ("c", "s", "three", "1")])
    found = {}
    for name, per_batch in (("together", None), ("apart", 1)):
        folder = str(tmp_path / name)
        for rows in (first, second):
            rows.coalesce(1).write.mode("append").parquet(folder)
        roots = [str(tmp_path / f"{name}-{kind}") for kind in ("chunks", "examples")]
        sync_stream(spark, folder, first.schema, *roots, str(tmp_path / f"{name}-state"), files_per_batch=per_batch).awaitTermination()
        found[name] = sorted((r.id, r.content) for r in tables.current(spark, roots[0], CHUNKS).collect())
    assert found["together"] == found["apart"] == [("a#0", "one more"), ("b#0", "two"), ("c#0", "three")]
