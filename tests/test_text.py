import random

from pyspark.sql import functions as F

from chartula.functions import metadata, scores, urls
from chartula.functions import text as tx
from chartula.operators import chunks as ck

PIECES = ["a", "bc", "é", "𝒳", " ", ". ", "\n", "\n\n", "```", "````", " ", "py\n", "x y"]


def random_texts(n, longest, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, longest))) for _ in range(n)]


def expected_chunks(text, size):
    """The chunking rule, stated plainly."""
    out, start = [], 0
    while start < len(text):
        if start + size >= len(text):
            out.append(text[start:].strip())
            break
        window = text[start : start + size]
        fence, para, stop = window.rfind("```"), window.rfind("\n\n"), window.rfind(". ")
        cut = size
        if fence > 0.3 * size:
            cut = fence
        elif para >= 0:
            cut = para if para > 0.3 * size else size
        elif stop > 0.3 * size:
            cut = stop + 1
        out.append(window[:cut].strip())
        start += cut
    return [c for c in out if c]


def test_chunks_follow_the_rule(spark):
    texts = random_texts(300, 150, 3)
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, markdown string")
    for size in (10, 37):
        got = {i: [] for i in range(len(texts))}
        for row in ck.chunk_texts(frame, size=size).orderBy("i", "chunk_number").collect():
            assert row.chunk_number == len(got[row.i])
            got[row.i].append(row.content)
        assert got == {i: expected_chunks(t, size) for i, t in enumerate(texts)}


def test_hard_cut_keeps_the_text(spark):
    frame = spark.createDataFrame([("u", "A" * 100)], "url string, markdown string")
    assert "".join(r.content for r in ck.chunk_texts(frame, size=50).collect()) == "A" * 100


def expected_blocks(md, least, context=1000):
    """The fence rule, stated plainly."""
    spots, at = [], 3 if md.strip().startswith("```") else 0
    while (at := md.find("```", at)) >= 0:
        spots.append(at)
        at += 3
    out = []
    for a, z in zip(spots[::2], spots[1::2]):
        section = md[a + 3 : z]
        head, newline, rest = section.partition("\n")
        language, code = "", section.strip()
        if newline and head.strip() and " " not in head.strip() and len(head.strip()) < 20:
            language, code = head.strip(), rest.strip()
        if len(code) >= least:
            out.append((code, language, md[max(0, a - context) : a].strip(), md[z + 3 : z + 3 + context].strip()))
    return out


def test_code_blocks_follow_the_rule(spark):
    texts = random_texts(300, 80, 5) + ["```py\n" + "x" * 1000 + "\n```", "a\n```py\n" + "x" * 999 + "\n```\nb", " ```\nx\n```"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, markdown string")
    for least in (0, 3, 1000):
        got = {i: [] for i in range(len(texts))}
        for r in ck.code_blocks(frame, min_length=least).orderBy("i", "chunk_number").collect():
            got[r.i].append((r.code, r.language, r.context_before, r.context_after))
            assert r.full_context == f"{r.context_before}\n\n{r.code}\n\n{r.context_after}"
        assert got == {i: expected_blocks(t, least) for i, t in enumerate(texts)}


def test_section_info(spark):
    frame = spark.createDataFrame([("# One\ntext #no\n## Two  words\n###\n",), ("plain text",)], "t string")
    rows = [r.i for r in frame.select(tx.section_info(F.col("t")).alias("i")).collect()]
    assert (rows[0].headers, rows[0].word_count, rows[0].char_count) == ("# One; ## Two  words", 8, 33)
    assert (rows[1].headers, rows[1].word_count) == ("", 2)


def test_word_count_is_unicode_aware(spark):
    texts = random_texts(100, 60, 9)
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.n for r in frame.select("i", tx.word_count(F.col("t")).alias("n")).collect()}
    assert got == {i: len(t.split()) for i, t in enumerate(texts)}


def test_numbering_across_documents(spark):
    rows = [(d, i) for d in range(20) for i in range(d % 4)]
    frame = spark.createDataFrame(rows, "doc int, chunk_number int").repartition(5)
    got = ck.number_across(frame, ["doc"]).orderBy("chunk_number").collect()
    assert [r.chunk_number for r in got] == list(range(len(rows)))
    assert [r.doc for r in got] == [d for d, _ in rows]


def test_urls(spark):
    cases = [
        ("https://u:p@host:8080/a/b?x#f", "u:p@host:8080"),
        ("file.txt", "file.txt"),
        ("/rooted/path", "/rooted/path"),
    ]
    frame = spark.createDataFrame(cases, "url string, want string")
    assert frame.filter(urls.source_id(F.col("url")) != F.col("want")).count() == 0
    one = spark.createDataFrame([("https://x/sitemap/a.txt",), ("https://x/my-sitemap/",), ("https://x/?sitemap",)], "url string")
    kinds = [r[0] for r in one.select(urls.url_class(F.col("url"))).collect()]
    assert kinds == ["text_file", "sitemap", "webpage"]


def test_scores(spark):
    cases = [("0.8", 0.8), ("7", 0.7), ("85", 0.85), ("950", 0.95), ("12000", 1.0), ("high", 0.9), ("irrelevant", 0.7), ("", 0.5), ("poor", 0.3), ("is .25", 0.25)]
    frame = spark.createDataFrame(cases, "r string, want double")
    assert frame.filter(F.abs(scores.parse_score(F.col("r")) - F.col("want")) > 1e-9).count() == 0


def test_metadata_containment(spark):
    stored = '{"category": "a", "tags": ["x", "y"], "nested": {"level": 2, "ok": true}, "n": 3, "none": null}'
    frame = spark.createDataFrame([(stored,)], "m string")
    yes = [{}, {"category": "a"}, {"tags": ["y"]}, {"nested": {"level": 2}}, {"n": 3, "nested": {"ok": True}}, {"none": None}]
    no = [{"category": "b"}, {"tags": ["z"]}, {"nested": {"level": 3}}, {"n": "3"}, {"missing": 1}, {"category": None}]
    for wanted in yes:
        assert frame.filter(metadata.contains(F.col("m"), wanted)).count() == 1, wanted
    for wanted in no:
        assert frame.filter(metadata.contains(F.col("m"), wanted)).count() == 0, wanted


def test_cuts_of_long_texts_take_time_in_proportion(spark):
    """Numbers are collected in short arrays: twice the text, about twice the time (many times 256 cuts)."""
    import time

    def seconds(size):
        frame = spark.range(1).select(F.expr(f"repeat('some words. and more\\n', {size})").alias("t"))
        cuts = frame.select(tx.chunk_cuts(tx.blocks(F.col("t"), 100), F.length("t"), 100).alias("c"))
        began = time.perf_counter()
        count, last = cuts.select(F.size("c"), F.element_at("c", -1)).first()
        assert last == 21 * size and count > size / 6
        return time.perf_counter() - began

    seconds(1000)
    small = min(seconds(20_000) for _ in range(2))
    assert seconds(40_000) < 4 * small + 1
