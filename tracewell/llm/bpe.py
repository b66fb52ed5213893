"""BPE encoding and decoding with chunk reuse.

Texts are cut into content-defined chunks: a rolling hash over sixteen bytes decides where a chunk
ends, so that a passage shared by several documents is cut alike in each. A chunk is encoded once
in a task and its ids are reused wherever that task meets it again. The word that straddles two
chunks is a join: it is put together again and re-encoded whole, out to the white space at both its
ends. Agreement is exact from there on: this tokenizer splits a text at every white space before it
merges anything, and a merge never leaves its piece, so the ids of a word depend on the word alone.

Chunks and words are kept for one task, up to fixed numbers of entries, so memory is bounded and no
text is shuffled. Texts with characters outside a well-understood set are encoded by the
`tokenizers` library itself.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracewell.llm._text import Recent, bounded_batches, slices, tidy, view

ENCODED = "ids binary, decoded string"

#: Characters whose class, case and normal form are the same in every Unicode version.
_KNOWN = re.compile("[\t\n\r\x20-\x7e¡-¬®-įı-ɏ‐-―‘-‟†-•…€]")
#: Of those, the ones whose lower case is among them too; texts with any other character go to the library.
_PLAIN = "".join(c for c in map(chr, range(0x2100)) if _KNOWN.match(c) and all(map(_KNOWN.match, c.lower())))
UNUSUAL = re.compile(f"[^{re.escape(_PLAIN)}]")
LONG_WORD, MAX_CHUNK = 256, 8192  # bytes; longer words and chunks are encoded, but not kept
LETTER = "a-zA-ZªµºÀ-ÖØ-öø-ɏ"
NUMBER = "0-9²³¹¼-¾"
_WORD_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^\\s{LETTER}{NUMBER}]+")
END = b"\xff"  # never a byte of UTF-8; stands for the mark of a word's end


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def library(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=2)
def specials(path: str) -> re.Pattern:
    added = [x["content"] for x in json.load(open(path, encoding="utf-8"))["added_tokens"]]
    return re.compile("|".join(map(re.escape, added)) or r"(?!)")


@lru_cache(maxsize=2)
def word_merger(path: str):
    """A merger of one piece of a word and the text of every id, for a vocabulary with a mark of word ends."""
    import tiktoken

    model = json.load(open(path, encoding="utf-8"))["model"]
    suffix, alphabet = model["end_of_word_suffix"], byte_alphabet()
    ranks: dict[bytes, int] = {}
    texts: dict[int, bytes] = {}
    added = specials(path)
    for token, number in model["vocab"].items():
        texts[number] = token.encode()
        if added.fullmatch(token):
            continue
        marked = suffix and token.endswith(suffix)
        key = bytes(alphabet[c] for c in (token[: -len(suffix)] if marked else token)) + END * bool(marked)
        if key in ranks:
            raise ValueError(f"two tokens have the bytes {key!r}")
        ranks[key] = number
    merger = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    return merger._core_bpe.encode_single_piece, texts


def _word_maker(path: str):
    """word -> (ids as bytes, decoded bytes)"""
    merge, texts = word_merger(path)

    def make(word: bytes) -> tuple[bytes, bytes]:
        ids: list[int] = []
        for piece in _WORD_PIECES.findall(word.decode()):
            ids += merge(piece.encode() + END)
        return array("I", ids).tobytes(), b" ".join([texts[i] for i in ids])

    return make


class ChunkEncoder:
    """Encodes texts to (ids as little-endian unsigned 32-bit integers, decoded text)."""

    def __init__(self, path: str, chunk_bytes: int = 512, words: int = 250_000, chunks: int = 8_000):
        self.path, self.mask = path, np.uint32(chunk_bytes - 1)
        self.make = _word_maker(path)
        self.words, self.chunks = Recent(self.make, words), Recent(self._chunk, chunks)
        self.table = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint32)

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Positions after which a chunk ends, by a hash of the sixteen bytes before, never inside a character."""
        hashed, factor = self.table[data], 0x01000193
        for step in (1, 2, 4, 8):
            wider = hashed.copy()
            wider[step:] += hashed[:-step] * np.uint32(factor)
            hashed, factor = wider, factor * factor & 0xFFFFFFFF
        ends = np.flatnonzero((hashed[:-1] >> np.uint32(7) & self.mask) == 0) + 1
        return ends[(data[ends] & 0xC0) != 0x80]

    def _chunk(self, chunk: bytes) -> tuple:
        """(first, last, inner ids, inner decoded): first and last are the parts of words at its ends; last is None if all is one part."""
        parts = chunk.split()
        if not parts:
            return b"", b"", b"", b""
        open_left, open_right = not chunk[:1].isspace(), not chunk[-1:].isspace()
        if len(parts) == 1 and open_left and open_right:
            return parts[0], None, b"", b""
        first = parts.pop(0) if open_left else b""
        last = parts.pop() if open_right else b""
        found = [self._word(w) for w in parts]
        return first, last, b"".join([x[0] for x in found]), b" ".join([x[1] for x in found])

    def _word(self, word: bytes) -> tuple[bytes, bytes]:
        return self.words[word] if len(word) <= LONG_WORD else self.make(word)

    def _document(self, data: bytes, ends: list[int]) -> tuple[bytes, bytes]:
        ids, decoded, held, at = [], [], [], 0
        chunks = self.chunks

        def join() -> None:  # the whole word, from white space to white space
            found = self._word(held[0] if len(held) == 1 else b"".join(held))
            ids.append(found[0])
            decoded.append(found[1])
            held.clear()

        for end in [*ends, len(data)]:
            chunk = data[at:end]
            at = end
            first, last, inner, text = chunks[chunk] if len(chunk) <= MAX_CHUNK else self._chunk(chunk)
            if first:
                held.append(first)
            if last is None:
                continue
            if held:
                join()
            if inner:
                ids.append(inner)
                decoded.append(text)
            if last:
                held.append(last)
        if held:
            join()
        return b"".join(ids), b" ".join(decoded)

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        marks, out = specials(self.path), [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if not UNUSUAL.search(t) and not marks.search(t)]
        encoded = [texts[i].lower().encode() for i in plain]
        lengths = np.array([len(x) for x in encoded], np.int64)
        borders = np.concatenate([[0], np.cumsum(lengths)])
        joined = b"".join(encoded)
        ends = self.cuts(np.frombuffer(joined, np.uint8)) if len(joined) > 32 else np.zeros(0, np.int64)
        lo, hi = np.searchsorted(ends, borders[:-1] + 16), np.searchsorted(ends, borders[1:])
        for k, i in enumerate(plain):
            out[i] = self._document(encoded[k], (ends[lo[k] : hi[k]] - borders[k]).tolist())
        for i, t in enumerate(texts):
            if out[i] is None:
                tokenizer = library(self.path)
                ids = tokenizer.encode(t, add_special_tokens=False).ids
                out[i] = np.array(ids, "<u4").tobytes(), tokenizer.decode(ids, skip_special_tokens=False).encode()
        return out


@lru_cache(maxsize=1)
def _encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


@tidy
def _encode_batches(batches, path: str, text: str):
    encoder = _encoder(path)
    for batch in batches:
        for part, texts in slices(batch, text):
            found = encoder.encode(texts.to_pylist())
            others = [part.column(i) for i, name in enumerate(part.schema.names) if name != text]
            ids = pa.array([x[0] for x in found], pa.binary())
            decoded = pa.array([x[1] for x in found], pa.binary()).cast(pa.string())
            names = [n for n in part.schema.names if n != text]
            yield pa.RecordBatch.from_arrays([*others, ids, decoded], [*names, "ids", "decoded"])


def bpe_encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, `ids` (binary, little-endian unsigned 32-bit) and `decoded` of each whole text.

    A null or empty text gives no ids and an empty decoded text; a text of any length, with or without
    white space, is encoded whole. Rows are independent: repeated rows
    give repeated results, null keys are kept, an empty table gives an empty table, and columns
    other than the key and the text are left out, whatever their names.
    """
    bounded_batches(docs.sparkSession)
    kept = docs.select(key, text)
    kind = kept.schema[key].dataType.simpleString()
    return kept.mapInArrow(partial(_encode_batches, path=path, text=text), f"`{key}` {kind}, {ENCODED}")
