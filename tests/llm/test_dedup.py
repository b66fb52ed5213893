import collections
import hashlib
import random
import re

import numpy as np
import pytest

from tracewell.llm import jaccard, substrings
from tracewell.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_spans(rows, size):
    seen, out = {}, {}
    for key, text in sorted(rows):
        words = WORD.findall(text or "")
        marks = [False] * len(words)
        for i in range(len(words) - size + 1):
            window = tuple(words[i : i + size])
            if window in seen:
                marks[i : i + size] = [True] * size
            seen.setdefault(window, (key, i))
        out[key] = (len(words), sum(marks), " ".join(w for w, m in zip(words, marks, strict=True) if not m))
    return out


def some_texts():
    r = random.Random(5)
    words = ["a", "b", "c", "dd", "é"]
    rows = [(i, " ".join(r.choice(words[: r.choice([1, 2, 5])]) for _ in range(r.randint(0, 100)))) for i in range(80)]
    return [*rows, (1000, None), (1001, ""), (1002, " \n\t ")]


@pytest.mark.parametrize(("size", "hot"), [(6, 400), (6, 3), (3, 2), (20, 400)])
def test_substrings_equal_brute_force(spark, size, hot):
    rows = some_texts()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, doc string, spans int")
    found = substrings.drop_repeats(docs, size=size, hot=hot).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in found} == brute_spans(rows, size)


def test_repeated_rows_and_null_keys_keep_their_words(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text)], "doc_id int, text string")
    found = sorted((r["doc_id"] or 0, r["n_removed"]) for r in substrings.drop_repeats(docs).collect())
    assert found == [(0, 0), (1, 0), (1, 0), (2, 30)]
    assert substrings.drop_repeats(docs.limit(0)).count() == 0


def test_cut_keeps_what_stands_between(spark):
    passage = " ".join(f"w{i}" for i in range(25))
    docs = spark.createDataFrame([(1, f"one\n{passage} end", 5), (2, f"two\t{passage}\n\nlast  words", 5), (3, passage, 5), (4, None, 0), (5, "kept  as\tis", 1)], "doc_id long, text string, n_chars int")
    found = {r["doc_id"]: (r["text"], r["n_chars"]) for r in substrings.cut_repeats(docs, count="n_chars").collect()}
    assert found == {1: (f"one\n{passage} end", 5), 2: ("two\tlast  words", 15), 4: (None, 0), 5: ("kept  as\tis", 1)}
    clashing = docs.withColumnRenamed("n_chars", "Spans").withColumn("doc", docs["doc_id"]).withColumn("version", docs["text"])
    again = substrings.cut_repeats(clashing)
    assert again.columns == ["doc_id", "text", "Spans", "doc", "version"]
    assert {r["doc_id"]: (r["text"], r["Spans"]) for r in again.collect()} == {k: (t, n if k != 2 else 5) for k, (t, n) in found.items()}


def test_rows_of_one_key_keep_their_own_words(spark):
    passage, others = " ".join(f"p{i}" for i in range(25)), " ".join(f"o{i}" for i in range(40))
    rows = [(1, f"{passage} end"), (5, f"{passage} tail"), (5, others), (7, f"x {others}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r["doc_id"], r["n_words"], r["kept"]) for r in substrings.drop_repeats(docs).collect())
    assert found == sorted([(1, 26, f"{passage} end"), (5, 26, "tail"), (5, 40, others), (7, 41, "x")])


def test_automaton_matches():
    r = random.Random(1)
    automaton, sequences = substrings.SuffixAutomaton(), [[r.randint(0, 2) for _ in range(30)] for _ in range(6)]
    inside = lambda x: any(x == s[i : i + len(x)] for s in sequences for i in range(len(s)))
    for s in sequences:
        automaton.add(s)
    for _ in range(20):
        query = [r.randint(0, 2) for _ in range(20)]
        for end, length in enumerate(automaton.matching(query)):
            longest = max((n for n in range(end + 2) if inside(query[end + 1 - n : end + 1])), default=0)
            assert length == longest


def brute_links(rows, k=5, threshold=0.8):
    sets = {}
    for key, text in rows:
        words = WORD.findall(text or "")
        sets[key] = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())
    links, parent = collections.Counter(), {x: x for x in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            common, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if union and common * 5 >= union * 4:
                links[a] += 1
                links[b] += 1
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {x: (find(x), links[x]) for x in sets}


def near_texts():
    r = random.Random(5)
    base = [" ".join(r.choice("abcdefgh") + str(r.randint(0, 50)) for _ in range(r.choice([3, 40, 90, 200]))) for _ in range(20)]
    rows = []
    for i in range(250):
        words = r.choice(base).split()
        for _ in range(r.choice([0, 0, 1, 1, 2, 5, 9])):
            words[r.randrange(len(words))] = f"zz{r.randint(0, 9)}"
        rows.append((i, " ".join(words)))
    for i in range(150):
        words = base[3].split() * 3
        for _ in range(r.choice([0, 1, 2])):
            words[r.randrange(len(words))] = f"q{r.randint(0, 99)}"
        rows.append((2000 + i, " ".join(words)))
    return [*rows, (5000, None), (5001, ""), (5002, " \n"), (5003, "x y"), (5004, "x  y")]


def test_join_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", 40)  # several blocks in a cluster
    rows = near_texts()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, rep int")
    found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.jaccard_join(docs).collect()}
    assert found == brute_links(rows)


def test_join_of_repeated_null_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (7, "g")], "doc_id long, text string")
    found = sorted((r["doc_id"] or 0, r["class_id"], r["copy_id"], r["n_links"]) for r in jaccard.jaccard_join(docs).collect())
    assert found == [(0, None, None, 0), (1, 1, 1, 1), (1, 1, 1, 1), (7, 7, 7, 0)]
    assert jaccard.jaccard_join(docs.limit(0)).count() == 0


def test_posterior_bound_never_drops_what_is_likely():
    least = jaccard.least_matches(0.8, 1e-6)
    assert len(least) == jaccard.HASHES // jaccard.STEP and least == sorted(least)
    assert 0 < least[0] < 0.8 * jaccard.STEP and least[-1] < 0.8 * jaccard.HASHES


def test_minhash_estimates_similarity():
    r = np.random.default_rng(2)
    a = r.integers(0, 1 << 63, 1000).astype(np.uint64)
    b = np.concatenate([a[:800], r.integers(0, 1 << 63, 200).astype(np.uint64)])
    one, two = jaccard.signatures([np.sort(a), np.sort(b)])
    assert abs((one == two).mean() - 800 / 1200) < 0.15


def test_components(spark):
    r = random.Random(4)
    pairs = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 160)] + [(r.randint(200, 400), r.randint(200, 400)) for _ in range(80)] + [(900, 900)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hash_of_a_word_is_the_same_anywhere():
    from tracewell.llm._text import span_hashes, word_spans

    data = np.frombuffer(b"ab cd ab\tcd", np.uint8)
    starts, ends, first = word_spans(data, np.array([0, 5, len(data)]))
    hashes = span_hashes(data, starts, ends)
    assert hashes[0] == hashes[2] and hashes[1] == hashes[3] and hashes[0] != hashes[1]
    assert first.tolist() == [0, 2, 4]
    assert hashlib.sha256(b"").hexdigest()


def brute_rows(rows, k=5):
    """Every row as a document of its own: (key, class, copy, links)."""
    one = brute_links([(i, t) for i, (_, t) in enumerate(rows)], k)
    sets = {i: frozenset(zip(*[WORD.findall(t or "")[j:] for j in range(k)], strict=False)) or tuple(WORD.findall(t or "")) for i, (_, t) in enumerate(rows)}
    out = []
    for i, (key, text) in enumerate(rows):
        group = [rows[j][0] for j in one if one[j][0] == one[i][0]]
        copies = [rows[j][0] for j in one if sets[j] == sets[i]] if WORD.search(text or "") else [key]
        out.append((key, min(group) if WORD.search(text or "") else key, min(copies), one[i][1]))
    return sorted(out)


@pytest.mark.parametrize("block", [1, 3, 40])
def test_join_of_repeated_rows_and_keys(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", block)
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(1, text), (1, text), (2, text + " extra"), (1, "five other words and more of them"), (3, "five other words and more of them"), (2, text + " extra"), (2, text + " or this"), (9, ""), (9, None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, cluster int")
    found = sorted((r["doc_id"], r["class_id"], r["copy_id"], r["n_links"]) for r in jaccard.jaccard_join(docs).collect())
    assert found == brute_rows(rows)
    assert (2, 1, 2, 4) in found and found.count((1, 1, 1, 4)) == 2


def test_long_chains_are_compared_by_bucket(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", 2)
    r = random.Random(8)
    words = [f"w{r.randint(0, 10**6)}" for _ in range(500)]
    rows = [(i, " ".join(words[6 * i : 6 * i + 80])) for i in range(60)]  # each is like its neighbours only
    copies = [(1000 + i, " ".join([*words[:80], f"x{i}"])) for i in range(20)]
    docs = spark.createDataFrame([*rows, *copies], "doc_id long, text string")
    found = {x["doc_id"]: (x["class_id"], x["n_links"]) for x in jaccard.jaccard_join(docs).collect()}
    assert found == brute_links([*rows, *copies])
