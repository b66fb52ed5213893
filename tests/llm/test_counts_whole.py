import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.test_tokens import TEXTS
from tracewell.llm import counts
from tracewell.llm.queries_tokens import tokenizer_path

SPACED = ["a  b", "if x:\n    return y", "  ", "   lead", "trail   ", " " * 40 + "x", "a\n  b\n    c", "▁▁x ▁ y", "|  a |    b  |", "﷽  ﷽   ﷽", "𝔘  " * 50]


def library(pieces, unknown, fallback):
    from tokenizers import Tokenizer, models, pre_tokenizers

    out = Tokenizer(models.Unigram(list(pieces), unknown, fallback))
    out.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)
    return out


@pytest.mark.parametrize("fallback", [True, False])
def test_whole_texts_count_as_in_the_library(fallback):
    pieces, unknown = counts.vocabulary(tokenizer_path("piece_bpe_32k.model"))
    whole, counter = library(pieces, unknown, fallback), counts._Runs(pieces, unknown, fallback)
    for text in [*TEXTS, *SPACED]:
        assert counter.count(text) == len(whole.encode(text, add_special_tokens=False).ids), text


def test_the_query_counts_runs():
    counter = counts.counter(tokenizer_path("piece_bpe_32k.model"))
    assert [counter.count(t) for t in ("a   b", "if x:\n    return y")] == [3, 8]


@settings(max_examples=200, deadline=None)
@given(st.text("ab ▁\nx", max_size=30), st.booleans())
def test_pieces_that_span_words(text, mark):
    pieces = [("<unk>", 0.0), ("a", -2.0), ("b", -2.0), ("a▁b", -3.0), ("▁▁", -2.0), ("▁a", -3.0), *([("▁", -2.0)] if mark else [])]
    counter = counts._Runs(pieces, 0, False)
    assert counter.uncut and counter.count(text) == len(library(pieces, 0, False).encode(text, add_special_tokens=False).ids)
