import os

import pytest

from tests.llm.test_dedup import brute_links, brute_spans

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_every_stage_equals_brute_force(spark):
    import corpus_pipeline as c
    from tracewell.llm import bpe, language, quality
    from tracewell.llm.queries_tokens import tokenizer_path

    assert [name for name, _ in c.STAGES] == ["quality classifier", "language ID", "n-gram Jaccard join", "substring dedup", "best-fit packing"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{DATA}/labels.parquet")

    good = c.checkpointed(c.good_quality(spark, docs, DATA))
    passed = {r["doc_id"] for r in quality.score_quality(docs, labels).filter("predicted = 1").collect()}
    assert {r["doc_id"] for r in good.collect()} == passed and good.columns == columns
    assert 0 < len(passed) < docs.count()

    known = c.checkpointed(c.known_language(spark, good, DATA))
    named = {r["doc_id"] for r in language.language_id(good).filter("lang_pred <> 'und' and score >= 0.5").collect()}
    assert {r["doc_id"] for r in known.collect()} == named and known.columns == columns

    one = c.checkpointed(c.one_of_each_group(spark, known, DATA))
    rows = [(r["doc_id"], r["text"]) for r in known.collect()]
    assert {r["doc_id"] for r in one.collect()} == {k for k, (least, _) in brute_links(rows).items() if least == k}

    cut = c.checkpointed(c.no_repeats(spark, one, DATA))
    rows = [(r["doc_id"], r["text"]) for r in one.collect()]
    expected = {k: kept for k, (n, removed, kept) in brute_spans(rows, 20).items() if removed < n or not n}
    assert {r["doc_id"]: " ".join(r["text"].split()) for r in cut.collect()} == {k: " ".join(v.split()) for k, v in expected.items()}
    assert all(len(r["text"]) == r["n_chars"] for r in cut.collect()) and cut.columns == columns

    packed = c.packed(spark, cut, DATA).collect()
    library = bpe.library(tokenizer_path("byte_bpe_50k.json"))
    total = {r["doc_id"]: len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in cut.collect()}
    got: dict = {}
    for r in packed:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == total


def test_repeated_rows_leave_one(spark):
    import corpus_pipeline as c

    docs = spark.createDataFrame([(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, "a b c d e f", "en", "s", 11), (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    left = c.one_of_each_group(spark, docs, "").collect()
    assert sorted((r["doc_id"] or 0) for r in left) == [0, 1]


ODD = "doc_id long, text string, lang string, n_chars int, spans int, version string, first boolean, n double, doc long, statistics string, label_id int"


def odd_rows(spark):
    good = "This is an ordinary sentence about the weather, and here is another one that says a little more. "
    texts = [None, "", "  ", good * 3, good * 3, "word " * 5000 + good, "12 34", good + "Its end differs from others.", "x" * 20_000]
    rows = [(i, t, "en" if t and "ordinary" in t else None, len(t or ""), i, "v", True, 0.5, 7, "s", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[3], (3, good * 2, "en", 5, None, None, None, None, None, None, None), (None, good, None, None, 1, "v", None, None, None, None, None), (3, None, *[None] * 9)], ODD)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_every_stage_takes_odd_rows(spark):
    import corpus_pipeline as c

    docs = odd_rows(spark)
    found = {}
    for name, stage in c.STAGES:
        out = stage(spark, docs, DATA)
        found[name] = [r.asDict() for r in out.collect()]
        if name != "best-fit packing":
            assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), DATA).count() == 0
    texts = lambda name: sorted((r["doc_id"] or -1, r["text"] or "") for r in found[name])
    everything = sorted((r["doc_id"] or -1, r["text"] or "") for r in docs.collect())
    kept = texts("quality classifier")
    assert all(kept.count(x) in (0, everything.count(x)) for x in everything) and {x[1] for x in kept}.isdisjoint({x[1] for x in everything if x not in kept})
    assert {x[0] for x in texts("language ID")}.isdisjoint({0, 1, 2, 6}) and (3, everything[-1][1]) not in texts("language ID")
    one = texts("n-gram Jaccard join")
    assert [x[0] for x in one].count(3) == 2 and 4 not in [x[0] for x in one] and {-1, 1, 2, 5, 6, 8} <= {x[0] for x in one}
    cut = {r["doc_id"]: r for r in found["substring dedup"] if r["doc_id"] != 3}
    assert 4 not in cut and cut[7]["text"].strip() == "Its end differs from others." or cut[7]["n_chars"] == len(cut[7]["text"])
    assert [r["text"] for r in found["substring dedup"] if r["doc_id"] is None] == [next(r["text"] for r in docs.collect() if r["doc_id"] is None)]
    assert sum(r["piece"] == 0 for r in found["best-fit packing"]) == len(everything)


def test_rows_of_one_id(spark):
    import corpus_pipeline as c

    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text, 1), (5, text + " end", 2), (5, "something else that stands alone here", 3), (5, "something else that stands alone here", 3), (9, text, 4), (9, "nine has a text of its own too", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
    left = [(r["doc_id"], r["text"]) for r in c.one_of_each_group(spark, docs, "").collect()]
    assert len(left) == 3 and sum(t.startswith(text) for _, t in left) == 1
    assert {(5, rows[2][1]), (9, rows[5][1])} < set(left)


def test_spent_tables_are_deleted(spark):
    from tracewell.llm import _text, substrings

    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(30 + i % 3))) for i in range(20)], "doc_id long, text string")
    with _text.spent_tables() as made:
        out = substrings.drop_repeats(docs)
        assert out.count() == 20 and len(made) == 0
    folder = _text.shared_folder(spark)
    before = set(os.listdir(folder))
    substrings.drop_repeats(docs).count()
    assert len(set(os.listdir(folder)) - before) == 1
