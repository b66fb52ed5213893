"""Token counts of a unigram vocabulary without its tokens: a count-only Viterbi.

An Aho-Corasick automaton enumerates every vocabulary piece in a word; a dynamic program carries the
best score and the number of pieces at each position. Ties are the library's: at one end position
the piece with the earliest start is kept, a later one only if its score is strictly higher; a
character that no piece of one character covers is an unknown; neighbouring unknowns are one; with
byte fallback they count their bytes. A text is cut before each run of spaces, which stays with the
word after it as space marks, for a piece may hold several marks. No piece spans such a cut, so the
count of a word with its run doesn't depend on its neighbours and is kept; under a vocabulary with
pieces that do span it, texts are counted uncut.
"""

from __future__ import annotations

import re
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame

from tracewell.llm._text import Recent, bounded_batches, slices, tidy

MARK = "▁"
UNKNOWN_PENALTY = 10.0  # of the library


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[tuple[tuple[str, float], ...], int]:
    """Pieces with their scores, and the id of the unknown piece, of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return tuple((model.id_to_piece(i), model.get_score(i)) for i in range(model.vocab_size())), model.unk_id()


class Counter:
    """Counts the pieces of words under a unigram vocabulary."""

    def __init__(self, pieces, unknown: int, byte_fallback: bool = True, words: int = 400_000):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        known = {}
        for i, (piece, score) in enumerate(pieces):
            if piece:
                known[piece] = (i, score)
        for piece, (i, score) in known.items():
            if i != unknown:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.singles = {piece for piece, (i, _) in known.items() if len(piece) == 1 and i != unknown}
        self.unknown_score = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.fallback = byte_fallback and all(f"<0x{b:02X}>" in known for b in range(256))
        self.memo = Recent(self.count_word, words)

    def count_word(self, word: str) -> int:
        """Pieces of one word. The automaton reports the matches at each end from the longest, so from the earliest start."""
        if not self.singles.issuperset(word):
            return self._count_with_unknowns(word)
        best, count, last = [0.0], [0], -1
        for end, (length, score) in self.automaton.iter(word):
            start = end + 1 - length
            total = best[start] + score
            if end != last:
                best.append(total)
                count.append(count[start] + 1)
                last = end
            elif total > best[-1]:
                best[-1], count[-1] = total, count[start] + 1
        return count[-1]

    def _count_with_unknowns(self, word: str) -> int:
        n = len(word)
        ends: list[list] = [[] for _ in range(n + 1)]
        for end, (length, score) in self.automaton.iter(word):
            ends[end + 1].append((length, score))
        best, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        for at in range(1, n + 1):
            top, found = 0.0, None
            for length, score in ends[at]:
                total = best[at - length] + score
                if found is None or total > top:
                    top, found = total, length
            if word[at - 1] not in self.singles:
                total = best[at - 1] + self.unknown_score
                if found is None or total > top:
                    top, found = total, 0
            best[at] = top
            if found:
                count[at] = count[at - found] + 1
            elif self.fallback:
                count[at], unknown[at] = count[at - 1] + len(word[at - 1].encode()), 1
            else:  # neighbouring unknowns are one piece
                count[at], unknown[at] = count[at - 1] + 1 - unknown[at - 1], 1
        return count[n]

    def count(self, text: str) -> int:
        memo = self.memo
        words = text.replace(MARK, " ").split(" ")
        if len(words) > 1 and not words[0]:
            del words[0]  # a leading space is the mark of the first word
        return sum([memo[w] for w in words]) if text else 0


class _Marked(Counter):
    def count_word(self, word: str) -> int:
        return super().count_word(MARK + word)


_LED = re.compile(" ( *[^ ]*)")


class _Runs(_Marked):
    """Counts whole texts: runs of spaces stay together, as in the library's model without a splitting step."""

    def __init__(self, pieces, *rest, **named):
        super().__init__(pieces, *rest, **named)
        self.uncut = MARK not in self.singles or any(re.search(f"[^{MARK}]{MARK}", piece) for piece, _ in pieces)

    def count_word(self, word: str) -> int:
        return super().count_word(word.replace(" ", MARK))

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(MARK, " ")
        if not text.startswith(" "):
            text = " " + text
        if self.uncut:
            return self.count_word(text[1:])
        memo = self.memo
        words = _LED.findall(text) if "  " in text else text[1:].split(" ")
        return sum([memo[w] for w in words])


@lru_cache(maxsize=1)
def counter(path: str) -> Counter:
    return _Runs(*vocabulary(path))


@tidy
def _count_batches(batches, path: str, text: str):
    counts = counter(path)
    for batch in batches:
        for part, texts in slices(batch, text):
            n = pa.array([counts.count(t) for t in texts.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), n], [part.schema.names[0], "n_tokens"])


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and `n_tokens` of each whole text; `path` is a sentencepiece model with scores.

    A null or empty text has no tokens. Rows are independent; null keys and repeated rows are kept;
    columns other than key and text are left out, whatever their names.
    """
    bounded_batches(docs.sparkSession)
    kept = docs.select(key, text)
    kind = kept.schema[key].dataType.simpleString()
    return kept.mapInArrow(partial(_count_batches, path=path, text=text), f"`{key}` {kind}, n_tokens long")
