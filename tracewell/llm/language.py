"""Language ID: multinomial naive Bayes over hashed character n-grams.

Counts over all training texts are summed per task in numpy, then per (language, slice of buckets);
the matrix of log probabilities, whose size depends on the languages and buckets only, goes out in a
broadcast, and whole texts are scored by gathering rows of it and summing them per text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm._text import bounded_batches, slices, tidy, view

BUCKETS = 1 << 14
ORDERS = (2, 3)
SMOOTHING = 0.5
SLICE = 512  # buckets in one row of counts
MAX_LANGUAGES = 512  # a matrix of 32 MB
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    found = _LETTER.search(text)
    while found and not found[0].isalpha():  # \w also holds numbers that are no digits
        found = _LETTER.search(text, found.end())
    return found is not None


def ngram_buckets(texts: pa.LargeStringArray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every character n-gram of the lower-case texts; n-grams never cross texts."""
    texts = pc.utf8_lower(texts)
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    data, _ = view(texts)
    chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), lengths)
    out_owner, out_bucket = [], []
    with np.errstate(over="ignore"):
        for n in ORDERS:
            count = len(chars) - n + 1
            if count <= 0:
                continue
            value = np.full(count, n, np.uint32)
            for j in range(n):
                value = value * np.uint32(0x01000193) ^ chars[j : j + count]
            value *= np.uint32(0x9E3779B1)
            inside = owner[:count] == owner[n - 1 :]
            out_owner.append(owner[:count][inside])
            out_bucket.append((value >> np.uint32(32 - (buckets.bit_length() - 1)))[inside])
    if not out_owner:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    return np.concatenate(out_owner), np.concatenate(out_bucket)


@tidy
def _count_batches(batches, buckets: int):
    totals: dict[str, np.ndarray] = {}
    documents: dict[str, int] = {}
    for batch in batches:
        for part, texts in slices(batch, "text"):
            owner, bucket = ngram_buckets(texts, buckets)
            codes = part.column("lang").dictionary_encode()
            names = codes.dictionary.to_pylist()
            lang = codes.indices.to_numpy(zero_copy_only=False)
            counted = np.bincount(lang[owner].astype(np.int64) * buckets + bucket, minlength=len(names) * buckets).reshape(len(names), buckets)
            for i, name in enumerate(names):
                totals[name] = totals.get(name, 0) + counted[i]
                documents[name] = documents.get(name, 0) + int((lang == i).sum())
    for name, total in totals.items():
        pieces = total.astype("<i8").reshape(-1, min(SLICE, buckets))
        n = len(pieces)
        columns = [pa.array([name] * n), pa.array(range(n), pa.int32()), pa.array([documents[name]] + [0] * (n - 1), pa.int64()), pa.array([p.tobytes() for p in pieces], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "slice", "documents", "counts"])


def _sum_counts(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, documents = None, 0
    for batch in batches:
        documents += pc.sum(batch.column("documents")).as_py() or 0
        for counts in batch.column("counts").to_pylist():
            add = np.frombuffer(counts, "<i8")
            total = add.copy() if total is None else total + add
    arrays = [pa.array([key[0].as_py()]), pa.array([key[1].as_py()], pa.int32()), pa.array([documents], pa.int64()), pa.array([total.tobytes()], pa.binary())]
    yield pa.RecordBatch.from_arrays(arrays, ["lang", "slice", "documents", "counts"])


class Model:
    """Language names, and log probabilities of buckets (rows) for them (columns)."""

    def __init__(self, names: list[str], log_prior: np.ndarray, log_probability: np.ndarray):
        self.names, self.log_prior, self.log_probability = names, log_prior, log_probability


def fit(training: DataFrame, buckets: int = BUCKETS) -> Model:
    """Learns from the columns text and lang; rows with a null in either are left out, repeated rows count as often as they appear.

    Any string is a language, the empty one and `und` too. The model has a column for each, so that
    its size, and the broadcast's, is bounded only by their number: more than MAX_LANGUAGES raise
    ValueError before a text is read, since such a column doesn't hold languages.
    """
    schema = "lang string, slice int, documents long, counts binary"
    rows = training.filter("text is not null and lang is not null").select("text", "lang")
    if rows.select("lang").distinct().count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    partial_counts = rows.mapInArrow(partial(_count_batches, buckets=buckets), schema)
    summed = partial_counts.groupBy("lang", "slice").applyInArrow(_sum_counts, schema)
    found: dict[str, dict] = {}
    documents: dict[str, int] = {}
    for r in summed.toLocalIterator():  # languages x buckets numbers, whatever the number of texts
        found.setdefault(r["lang"], {})[r["slice"]] = np.frombuffer(bytes(r["counts"]), "<i8")
        documents[r["lang"]] = documents.get(r["lang"], 0) + r["documents"]
    names = sorted(found)
    if not names:
        return Model([], np.zeros(0), np.zeros((buckets, 0), np.float32))
    counts = np.array([np.concatenate([found[x][i] for i in sorted(found[x])]) for x in names], np.float64) + SMOOTHING
    prior = np.array([documents[x] for x in names], np.float64)
    return Model(names, np.log(prior / prior.sum()), np.log(counts / counts.sum(axis=1, keepdims=True)).T.astype(np.float32).copy())


def score(texts: pa.LargeStringArray, model: Model) -> tuple[list[str], np.ndarray]:
    """The language of the highest posterior, and its share of the posteriors tempered by the square root of the number of n-grams."""
    n = len(texts)
    if not model.names:
        return [UNDETERMINED] * n, np.zeros(n)
    owner, bucket = ngram_buckets(texts, len(model.log_probability))
    grams = np.bincount(owner, minlength=n)
    total = np.empty((n, len(model.names)))
    for j in range(len(model.names)):
        total[:, j] = np.bincount(owner, model.log_probability[bucket, j], n)
    total += model.log_prior
    best = total.argmax(axis=1)
    scaled = total / np.sqrt(np.maximum(grams, 1))[:, None]
    weight = np.exp(scaled - scaled.max(axis=1, keepdims=True))
    confidence = 1 / weight.sum(axis=1)
    names = [model.names[b] for b in best]
    for i, text in enumerate(texts.to_pylist()):
        if not has_letter(text):
            names[i], confidence[i] = UNDETERMINED, 0.0
    return names, confidence


@tidy
def _score_batches(batches, model, text: str, keep: list[str]):
    for batch in batches:
        for part, texts in slices(batch, text, 1 << 20):
            names, confidence = score(texts, model.value)
            arrays = [*(part.column(c) for c in keep), pa.array(names, pa.string()), pa.array(confidence)]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "lang_pred", "score"])


def identify(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, `lang_pred` and `score` (0 to 1) of each whole text.

    A text that is null or has no letter is `und` with score 0, and so is every text if nothing was
    learned. A text too short for an n-gram gets the commonest language. Equal posteriors go to the
    first name in sorted order. A learned language may be named `und` itself. Texts of any length are
    read whole. Repeated rows get equal results; null ids are kept; other columns are left out.
    """
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = list(dict.fromkeys([*keep, text]))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    run = partial(_score_batches, model=sent, text=text, keep=list(keep))
    return docs.select(*kept).mapInArrow(run, f"{schema}, lang_pred string, score double")


@tidy
def _filter_batches(batches, model, text: str, least: float):
    for batch in batches:
        for part, texts in slices(batch, text, 1 << 20):
            names, confidence = score(texts, model.value)
            yield part.filter(pa.array([n != UNDETERMINED and c >= least for n, c in zip(names, confidence, strict=True)]))


def keep_identified(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows, with all columns, whose text has a language with a score of at least `least`. One narrow pass over the texts.

    Texts without a letter go, null and empty ones among them, and so do all if nothing was learned.
    """
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(partial(_filter_batches, model=sent, text=text, least=least), docs.schema)


def held_out(key: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the documents that are not held out and have a language."""
    bounded_batches(docs.sparkSession)
    known = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    model = fit(docs.filter(known))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
