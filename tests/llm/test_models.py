import os
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tracewell.llm import language, quality, topk

DATA = "/root/testdata/sf0.001"


def brute_top(rows, k=10):
    good = {i: np.floor(1024 * np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for q, a in good.items():
        if q % 100:
            continue
        scores = sorted((-int(a @ b), i) for i, b in good.items() if i != q and len(b) == len(a))
        out |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize("scale", ["unit", "spread", "copies"])
def test_top_k_equals_brute_force(spark, scale):
    r = np.random.default_rng(1)
    vectors = r.normal(size=(900, 12))
    if scale == "unit":
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    elif scale == "spread":
        vectors *= r.lognormal(0, 1.5, size=(900, 1))
    else:
        vectors[:600] = vectors[0]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(1000, None), (1100, []), (1200, [None] * 12), (1300, [float("nan")] * 12), (1400, [float("inf")] * 12), (1500, [1.0, 2.0]), (None, [1.0] * 12)]
    frame = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<float>, rank int")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    found = topk.top_k(frame, frame.filter("vec_id % 100 = 0")).collect()
    assert {(x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in found} == brute_top(rows)
    assert topk.top_k(frame.limit(0), frame.limit(0)).count() == 0


def test_small_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BYTES", 8 * 4 * 3)
    r = np.random.default_rng(2)
    rows = [(i * 25, [float(np.float32(x)) for x in r.normal(size=4)]) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    found = topk.top_k(frame, frame.filter("vec_id % 100 = 0")).collect()
    assert {(x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in found} == brute_top(rows)


def test_isotonic_is_the_best_rising_fit():
    score, label = np.array([0.1, 0.2, 0.3, 0.4, 0.5]), np.array([0.0, 1.0, 0.0, 1.0, 1.0])
    at, value = quality.isotonic(score, label)
    assert value.tolist() == [0.0, 0.5, 1.0] and at.tolist() == pytest.approx([0.1, 0.25, 0.45])


def test_features_approximate_the_gaussian_kernel():
    x = np.random.default_rng(0).normal(size=(40, quality.N_STATISTICS))
    made = quality.Features(np.zeros(quality.N_STATISTICS), np.ones(quality.N_STATISTICS), features=20000)(x)[:, 1:]
    distance = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert np.abs(made @ made.T - np.exp(-distance / (2 * quality.N_STATISTICS))).max() < 0.06


def test_statistics_don_t_depend_on_neighbours():
    texts = ["", "One two.\nOne two.\nThree!", "\n\n", "a", "ÄÖ ü\n", "x" * 50]
    alone = np.vstack([quality.statistics(pa.array([t], pa.large_string())) for t in texts])
    assert np.allclose(alone, quality.statistics(pa.array(texts, pa.large_string())))
    assert np.isfinite(alone).all()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_quality_and_language_on_held_out_rows(spark):
    folder = DATA.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    scored = quality.score_quality(docs, labels).collect()
    assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in scored)
    held = [r["predicted"] == truth[r["doc_id"]] for r in scored if r["held_out"] and r["doc_id"] in truth]
    assert sum(held) / len(held) > 0.95
    langs = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    named = language.language_id(docs).collect()
    held = [r["lang_pred"] == langs[r["doc_id"]] for r in named if r["held_out"]]
    assert len(named) == len(langs) and sum(held) / len(held) > 0.98


def test_odd_rows_of_both_models(spark):
    texts = [None, "", "   ", "12 34 !!", "½ ²", "the and of the", "der und die der", "x" * 300000]
    docs = spark.createDataFrame([(i, t, "de" if t and "der" in t else "en" if t and "the" in t else None, 5) for i, t in enumerate(texts)] + [(None, "the", None, 1), (5, "the and of the", "en", 1)], "doc_id long, text string, lang string, score int")
    found = {r["doc_id"]: r for r in language.language_id(docs).collect()}
    assert [found[i]["lang_pred"] for i in range(5)] == ["und"] * 5
    assert len(found) == 9
    nothing = language.identify(docs, language.fit(docs.limit(0))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)] + [(None, 1), (3, None)], "doc_id long, quality int")
    scores = quality.score_quality(docs, labels).collect()
    assert len(scores) == 10 and all(0 <= r["score"] <= 1 for r in scored) if (scored := scores) else False
    assert {r["score"] for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert language.language_id(docs.limit(0)).count() == 0 and quality.score_quality(docs.limit(0), labels).count() == 0


def test_ngrams_stay_in_their_text():
    owner, bucket = language.ngram_buckets(pa.array(["ab", "", "çd", "a"], pa.large_string()))
    assert sorted(owner.tolist()) == [0, 2]
    alone = language.ngram_buckets(pa.array(["çd"], pa.large_string()))[1]
    assert bucket[owner == 2].tolist() == alone.tolist()


def test_products_beyond_doubles_are_exact(spark):
    r = np.random.default_rng(7)
    rows = [(i, [float(x) for x in r.choice([-1, 1], 5) * r.integers(1 << 17, 1 << 19, 5)]) for i in range(150)]
    rows += [(200, [1e300, 1.0]), (300, [1e300, 2.0]), (400, [1e307, 1.0]), (500, [-1e300, 0.5])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows if max(map(abs, v)) < 1e305}
    low, high = -(1 << 63), (1 << 63) - 1
    expected = set()
    for q in (i for i in whole if i % 100 == 0):
        scores = sorted((-min(max(sum(a * b for a, b in zip(whole[q], v, strict=True)), low), high), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))
        expected |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:10])}
    found = topk.top_k(frame, frame.filter("vec_id % 100 = 0")).collect()
    assert {(x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in found} == expected


def test_repeated_vectors_and_queries(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [3.0, 5.0]), (1, [3.0, 5.0]), (2, [5.0, 3.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in topk.top_k(frame, frame.filter("vec_id % 100 = 0")).collect())
    assert found == [(0, 1, 1, 5 << 20), (0, 2, 1, 5 << 20), (0, 3, 2, 3 << 20)]


def best_rising(score, label):
    """The isotonic fit by its min-max formula over the distinct scores."""
    values = sorted(set(score))
    groups = [[y for s, y in zip(score, label, strict=True) if s == v] for v in values]
    mean = lambda i, j: sum(map(sum, groups[i : j + 1])) / sum(map(len, groups[i : j + 1]))
    return {v: max(min(mean(i, j) for j in range(k, len(values))) for i in range(k + 1)) for k, v in enumerate(values)}


@pytest.mark.parametrize("seed", range(20))
def test_isotonic_equals_the_min_max_formula(seed):
    r = np.random.default_rng(seed)
    score, label = r.integers(0, 12, 60) / 10, r.integers(0, 2, 60).astype(float)
    order = r.permutation(60)
    at, value = quality.isotonic(score, label)
    again = quality.isotonic(score[order], label[order])
    assert np.allclose(again[0], at) and np.allclose(again[1], value)
    expected = sorted(set(best_rising(score.tolist(), label.tolist()).values()))
    assert np.allclose(sorted(set(np.round(value, 12))), sorted(set(np.round(expected, 12))))


def test_tied_scores_are_one_pool():
    for labels in ([0, 0, 1, 1], [1, 1, 0, 0], [0, 1, 0, 1]):
        at, value = quality.isotonic(np.full(4, 0.3), np.array(labels, float))
        assert at.tolist() == pytest.approx([0.3]) and value.tolist() == [0.5]


def test_summed_equations_equal_one_ridge_regression(spark):
    texts = [" ".join(["word"] * (i % 7 + 1)) + "!" * (i % 3) + f" {i} Some more text here." * (i % 5) for i in range(90)]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, statistics int").repartition(5)
    labels = spark.createDataFrame([(i, int(i % 5 > 1)) for i in range(90)], "doc_id long, quality int")
    model = quality.learn_quality(docs, labels)
    taught = [i for i in range(90) if zlib.crc32(str(i).encode()) % 3 != 1]
    x = quality.statistics(pa.array([texts[i] for i in taught], pa.large_string()))
    y = np.array([i % 5 > 1 for i in taught], float)
    features = quality.Features(x.mean(axis=0), np.sqrt(np.maximum(x.var(axis=0), 1e-6)))
    z = features(x)
    penalty = np.full(z.shape[1], quality.RIDGE * len(y) / z.shape[1])
    penalty[0] = 1e-9
    weights = np.linalg.lstsq(np.vstack([z, np.diag(np.sqrt(penalty))]), np.concatenate([y, np.zeros(z.shape[1])]), rcond=None)[0]
    assert np.allclose(model.features(x) @ model.weights, z @ weights, atol=1e-4)


def plain_bayes(training, text, buckets):
    """Multinomial naive Bayes, gram by gram."""
    grams = lambda t: language.ngram_buckets(pa.array([t], pa.large_string()), buckets)[1].tolist()
    names = sorted({lang for _, lang in training})
    posterior = {}
    for name in names:
        own = [g for t, lang in training if lang == name for g in grams(t)]
        log = np.log(sum(lang == name for _, lang in training) / len(training))
        for g in grams(text):
            log += np.log((own.count(g) + language.SMOOTHING) / (len(own) + language.SMOOTHING * buckets))
        posterior[name] = log
    return max(names, key=lambda n: posterior[n]), posterior


def test_language_equals_plain_naive_bayes(spark):
    r = np.random.default_rng(5)
    word = lambda letters: "".join(r.choice(list(letters), r.integers(1, 6)))
    training = [(" ".join(word("abcx") for _ in range(6)), "aa") for _ in range(36)] + [(" ".join(word("bcdx") for _ in range(6)), "bb") for _ in range(4)] + [("zz zz", "und")]
    model = language.fit(spark.createDataFrame(training, "text string, lang string"), 64)
    asked = [word("abcdx") for _ in range(60)] + ["d", "dd", "bd", "z zz", " ".join(word("bcd") for _ in range(40))]
    names, confidence = language.score(pa.array(asked, pa.large_string()), model)
    for text, name, c in zip(asked, names, confidence, strict=True):
        best, posterior = plain_bayes(training, text, 64)
        assert posterior[name] == pytest.approx(posterior[best], abs=1e-4) and 1 / 3 <= c <= 1
    assert len({*names}) == 3


def test_too_many_languages_are_told_before_any_text_is_read(spark):
    rows = spark.range(language.MAX_LANGUAGES + 1).selectExpr("'text' as text", "cast(id as string) as lang")
    with pytest.raises(ValueError, match="languages"):
        language.fit(rows)
