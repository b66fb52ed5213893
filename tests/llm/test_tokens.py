import hashlib
import itertools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.llm import bpe, counts, packing
from tracewell.llm.queries_tokens import tokenizer_path

TEXTS = [
    "",
    " ",
    "a",
    "The quick  brown fox.\n\nJumps over don't we'll   x",
    "x<|endoftext|>y <|startoftext|>",
    "İstanbul ΣΑΣ ß naïve café 1234 ½² x½",
    "日本語 テキスト",
    "\x0b\x0c a\x1cb\r\ncd ",
    "fi ﬁ Å é",
    " lead\n\n  x",
    "word " * 3000,
    "Zzxxyy" * 500,
    "%%% $$$ #token = \"24be64439e3e49cf46b2d7c90f3602a3\"",
]


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_word_bpe_equals_the_library():
    path = tokenizer_path("word_bpe_49k.json")
    library = bpe.library(path)
    for text, (got, decoded) in zip(TEXTS, bpe.ChunkEncoder(path).encode(TEXTS), strict=True):
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids(got) == expected
        assert decoded.decode() == library.decode(expected, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8", max_codepoint=0x2FF), max_size=200), max_size=4))
def test_word_bpe_on_any_text(texts):
    path = tokenizer_path("word_bpe_49k.json")
    encoder = bpe.ChunkEncoder(path, chunk_bytes=32)
    texts = [t * 3 for t in texts]
    for text, (got, _) in zip(texts, encoder.encode(texts), strict=True):
        assert ids(got) == bpe.library(path).encode(text, add_special_tokens=False).ids


def test_byte_bpe_equals_the_library():
    path = tokenizer_path("byte_bpe_50k.json")
    encoder = packing.ByteEncoder(path)
    for text in TEXTS:
        assert ids(encoder.encode(text)) == bpe.library(path).encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(codec="utf-8", max_codepoint=0x2FF), max_size=300))
def test_byte_bpe_on_any_text(text):
    path = tokenizer_path("byte_bpe_50k.json")
    assert ids(packing.ByteEncoder(path).encode(text)) == bpe.library(path).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("fallback", [True, False])
def test_counts_equal_the_library(fallback):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces, unknown = counts.vocabulary(tokenizer_path("piece_bpe_32k.model"))
    library = Tokenizer(models.Unigram(list(pieces), unknown, fallback))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    counter = counts._Marked(pieces, unknown, fallback)
    for text in [*TEXTS, "a\nb", "▁x ▁", " x ", "𝔘𝔫 ﷽ ﷽﷽ x﷽"]:
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), text


def test_ties_keep_the_earliest_start():
    counter = counts.Counter([("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0)], 0, False)
    assert counter.count_word("ab") == 1  # one piece and two pieces score alike
    assert counter.count_word("aba") == 2


@pytest.mark.parametrize("seed", range(20))
def test_fullest_is_the_best_subset(seed):
    random = np.random.default_rng(seed)
    lengths = random.integers(1, 40, 9).tolist()
    room = int(random.integers(10, 120))
    best = max((sum(c) for n in range(10) for c in itertools.combinations(lengths, n) if sum(c) <= room), default=0)
    counted = {x: lengths.count(x) for x in set(lengths)}
    found = packing.fullest(counted, room)
    assert sum(x * n for x, n in found) == best
    assert all(n <= counted[x] for x, n in found)


def test_plan_places_everything_once():
    random = np.random.default_rng(3)
    counted = {int(x): int(n) for x, n in zip(random.integers(1, 1025, 300), random.integers(1, 5000, 300), strict=True)}
    plan = packing.min_bin_slack(counted)
    used: dict[int, int] = {}
    for times, need in plan:
        assert sum(x * n for x, n in need) <= 1024
        for x, n in need:
            used[x] = used.get(x, 0) + n * times
    assert used == counted
    assert packing.min_bin_slack({}) == []


def rows(spark):
    texts = ["", None, "short text", "word " * 2000, "short text", "tail " * 1023, "tail " * 1024]
    return spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(texts)] + [(None, "no id", "x", 1), (2, "short text", "x", 1)], "doc_id long, text string, piece string, length int")


def test_packing_is_whole_and_gapless(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    got = [r.asDict() for r in packing.pack_documents(rows(spark), path).collect()]
    library = bpe.library(path)
    expected = []
    for r in rows(spark).collect():
        whole = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        first = (len(whole) - 1) % 1024 + 1
        borders = [0, *range(first, len(whole) + 1, 1024)]
        for k, (a, b) in enumerate(zip(borders, borders[1:], strict=False)):
            expected.append((r["doc_id"], k, a, b - a, zlib.crc32(np.array(whole[a:b], "<u4").tobytes())))
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=key) == sorted(expected, key=key)
    by: dict = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(rows(spark).limit(0), path).count() == 0


def test_encode_and_count_tables(spark):
    got = bpe.bpe_encode(rows(spark), tokenizer_path("word_bpe_49k.json")).collect()
    assert len(got) == 9
    empty = [r for r in got if r["doc_id"] in (0, 1)]
    assert all(bytes(r["ids"]) == b"" and r["decoded"] == "" for r in empty)
    assert len({hashlib.sha256(bytes(r["ids"])).hexdigest() for r in got if r["doc_id"] in (2, 4)}) == 1
    found = {r["doc_id"]: r["n_tokens"] for r in counts.token_counts(rows(spark), tokenizer_path("piece_bpe_32k.model")).collect()}
    assert found[0] == found[1] == 0 and found[3] > 2000 and None in found
    assert bpe.bpe_encode(rows(spark).limit(0), tokenizer_path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_best_fit_and_mended_plans_are_whole(seed):
    random = np.random.default_rng(seed)
    counted = {int(x): int(n) for x, n in zip(random.integers(1, 1025, 40), random.integers(1, 40, 40), strict=True)}
    plan = packing.min_bin_slack(dict(counted))
    for found in (packing.best_fit(counted), packing.mended(plan)):
        used: dict[int, int] = {}
        for times, need in found:
            assert times > 0 and sum(x * n for x, n in need) <= 1024
            for x, n in need:
                used[x] = used.get(x, 0) + n * times
        assert used == counted
    assert sum(t for t, _ in packing.mended(plan)) <= sum(t for t, _ in plan)


def test_mending_brings_the_plan_to_the_bound():
    counted = {700: 300, 345: 2000, 320: 310, 4: 100}
    plan = packing.mended(packing.min_bin_slack(dict(counted)))
    assert sum(t for t, _ in plan) <= sum(t for t, _ in packing.best_fit(counted))


def test_every_plain_character_encodes_as_in_the_library():
    path = tokenizer_path("word_bpe_49k.json")
    library = bpe.library(path)
    texts = [f"{a}{c}{b}" for c in bpe._PLAIN for a, b in ((":", ":"), ("a", "b"), (" ", " "), ("1", "2"))] + [f":{chr(c)}:" for c in range(0x80, 0x2100)]
    for text, (got, decoded) in zip(texts, bpe.ChunkEncoder(path).encode(texts), strict=True):
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids(got) == expected, text
        assert decoded.decode() == library.decode(expected, skip_special_tokens=False)


def test_a_long_text_without_white_space():
    path = tokenizer_path("word_bpe_49k.json")
    random = np.random.default_rng(4)
    text = "".join(chr(97 + x) for x in random.integers(0, 26, 60_000)) + "." + "ab" * 20_000
    (got, _), *_ = bpe.ChunkEncoder(path).encode([text])
    assert ids(got) == bpe.library(path).encode(text, add_special_tokens=False).ids


def test_one_key_and_text_for_all_rows_is_packed_over_many_buckets(spark):
    docs = spark.range(4000).selectExpr("cast(null as long) as doc_id", "'the same text' as text").repartition(4)
    got = packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))
    length = got.first()["length"]
    per = 1024 // length
    places = {(r["sequence_id"], r["offset"]) for r in got.collect()}
    assert len(places) == 4000 and len({s for s, _ in places}) == -(-4000 // per)
