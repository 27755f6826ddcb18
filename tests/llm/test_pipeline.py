"""Every stage of the pipeline against a plain version of it on the smallest table."""

import numpy as np

import corpus_pipeline
from tests.llm.test_near_copies import groups
from tests.llm.test_suffix_dedup import brute

FOLDER = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def rows_of(docs):
    return {r.doc_id: r for r in docs.collect()}


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    known = STAGES["language"](spark, docs, FOLDER)
    assert known.columns == docs.columns and 0.97 * docs.count() <= known.count() <= docs.count()

    single = STAGES["near_duplicates"](spark, known, FOLDER)
    before, after = rows_of(known), rows_of(single)
    group = groups({i: r.text for i, r in before.items()})
    assert set(after) == set(group.values()) and all(after[i] == before[i] for i in after)

    cut = STAGES["repeats"](spark, single, FOLDER)
    order = sorted(after)
    for i, mask in zip(order, brute([after[i].text for i in order]), strict=True):
        raw = after[i].text.encode()
        runs = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(int), [0]])))
        kept = raw
        for begin, end in reversed([(int(a), int(b)) for a, b in zip(runs[::2], runs[1::2], strict=True)]):
            while begin < end and raw[begin] & 0xC0 == 0x80:
                begin += 1
            while end > begin and end < len(raw) and raw[end] & 0xC0 == 0x80:
                end -= 1
            kept = kept[:begin] + kept[end:]
        found = rows_of(cut).get(i) if i == order[0] else texts.get(i)
        if i == order[0]:
            texts = rows_of(cut)
        assert (found.text if found else "") == kept.decode()
        assert found is None or found.n_chars == len(found.text)

    mixed = STAGES["mix"](spark, cut, FOLDER)
    words = lambda rows: sum(len(r.text.split()) for r in rows)
    assert mixed.columns == docs.columns
    assert abs(words(mixed.collect()) - 1.5 * words(cut.collect())) < 0.1 * words(cut.collect())

    packed = STAGES["pack"](spark, mixed, FOLDER)
    assert packed.filter("start = 0").count() == mixed.count()


def test_odd_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra string, size int, fp string"
    rows = [(1, "The words of a text. " * 30, "en", "s", 1, "x", 1, "f"), (1, "The words of a text. " * 30, "en", "s", 1, "x", 1, "f"), (2, None, None, None, None, None, None, None), (None, "Les mots du texte. " * 30, "fr", None, 1, "y", 2, "g"), (3, "", "en", "s", 0, "x", 1, "f")]
    docs = spark.createDataFrame(rows, schema)
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, FOLDER)
            if name != "pack":
                assert out.columns == docs.columns
            out.collect()
    for name in ("near_duplicates", "repeats"):
        assert STAGES[name](spark, docs, FOLDER).filter("doc_id = 1").count() == (1 if name == "near_duplicates" else 2)
    assert corpus_pipeline.run(spark, FOLDER).count() > 0


def test_rows_without_ids_keep_one_of_each_group(spark):
    text, other = "The words of a text. " * 30, " ".join(f"other{n}" for n in range(90))
    rows = [(3, text), (None, text), (None, other), (None, other), (4, "alone in the world"), (4, "alone in the world"), (None, "unlike anything else here"), (5, text), (5, "five has another text")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = sorted(((r.doc_id or 0, r.text) for r in STAGES["near_duplicates"](spark, docs, FOLDER).collect()))
    assert out == sorted([(3, text), (4, "alone in the world"), (0, other), (0, "unlike anything else here"), (5, "five has another text")])
