"""Quality classifier: ridge regression on random Fourier features, with isotonic calibration.

Statistics of the whole texts of labelled rows give normal equations per partition, which are summed
(their size depends on the number of features alone) and solved; random Fourier features approximate
a Gaussian kernel over the standardised statistics. Each half of the training rows is scored by a
model of the other half, and isotonic regression of the labels on those scores maps scores to
probabilities. One more pass measures and scores all texts.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm._text import bounded_batches, checkpointed, gram_hashes, mix, release, slices, span_hashes, tidy, view, word_spans

FEATURES = 256
RIDGE = 1e-3
TRAINING_ROWS = 200_000  # the most labelled rows that a model learns from, chosen by a hash of their id
PARTITIONS = 32

_CLASS = np.zeros(256, np.int8)  # of bytes: 0 other ASCII, then as below
for _i, _set in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", ".,;:'\"-", "!?", "#$%&*@^~+=", "|<>{}[]()/\\_`"), 1):
    for _c in _set:
        _CLASS[ord(_c)] = _i
_CLASS[128:] = 10
CLASSES = 11
N_STATISTICS = CLASSES + 13


def _distinct(values: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text: how many distinct values it has, and how often its commonest one stands there."""
    with np.errstate(over="ignore"):
        keyed = values ^ mix(owner.astype(np.uint64) + np.uint64(1))
    _, at, count = np.unique(keyed, return_index=True, return_counts=True)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, owner[at], count)
    return np.bincount(owner[at], minlength=n), most


def statistics(texts: pa.LargeStringArray) -> np.ndarray:
    """One row of N_STATISTICS numbers for each text; an empty text has defined ones too."""
    data, at = view(texts)
    n = len(texts)
    size = np.diff(at)
    owner = np.repeat(np.arange(n), size)
    classes = np.bincount(owner * CLASSES + _CLASS[data], minlength=n * CLASSES).reshape(n, CLASSES)
    share = classes / np.maximum(size, 1)[:, None]
    starts, ends, first = word_spans(data, at)
    words, count = span_hashes(data, starts, ends), np.diff(first)
    of = np.repeat(np.arange(n), count)
    length = (ends - starts).astype(np.float64)
    some = np.maximum(count, 1)
    mean = np.bincount(of, length, n) / some
    spread = np.sqrt(np.maximum(np.bincount(of, length**2, n) / some - mean**2, 0))
    kinds, top = _distinct(words, of, n)
    grams = gram_hashes(words, 3)
    inside = of[: len(grams)] == of[2:] if len(grams) else np.zeros(0, bool)
    gram_kinds, gram_top = _distinct(grams[inside], of[: len(grams)][inside], n)
    gram_count = np.maximum(count - 2, 1)
    breaks = np.flatnonzero(data == 10)
    line_ends = np.union1d(breaks, at[1:][size > 0])
    line_starts = np.union1d(breaks + 1, at[:-1][size > 0])
    line_starts = line_starts[line_starts < len(data)]
    line_ends = line_ends[: len(line_starts)] if len(line_ends) >= len(line_starts) else np.append(line_ends, len(data))
    line_of = owner[line_starts] if len(line_starts) else np.zeros(0, np.int64)
    lines = np.bincount(line_of, minlength=n)
    line_kinds, _ = _distinct(span_hashes(data, line_starts, np.maximum(line_ends, line_starts)), line_of, n)
    shout = (_CLASS[data[ends - 1]] >= 7) & (_CLASS[data[ends - 1]] <= 9) if len(ends) else np.zeros(0, bool)
    more = [
        np.log1p(size),
        np.log1p(count),
        mean,
        spread,
        kinds / some,
        top / some,
        gram_kinds / gram_count,
        gram_top / gram_count,
        np.log1p(count / np.maximum(lines, 1)),
        line_kinds / np.maximum(lines, 1),
        np.bincount(of, length <= 3, n) / some,
        np.bincount(of, length >= 14, n) / some,
        np.bincount(of, shout, n) / some,
    ]
    return np.column_stack([np.sqrt(share), *more])


@tidy
def _statistic_batches(batches, keep: list[str], text: str):
    for batch in batches:
        for part, texts in slices(batch, text, 1 << 20):
            rows = statistics(texts)
            flat = pa.array(rows.ravel())
            offsets = pa.array(np.arange(0, rows.size + 1, N_STATISTICS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.ListArray.from_arrays(offsets, flat)], [*keep, "statistics"])


def text_statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns `keep`, and statistics (an array of N_STATISTICS numbers) of every whole text."""
    bounded_batches(docs.sparkSession)
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, text).mapInArrow(partial(_statistic_batches, keep=list(keep), text=text), f"{kinds}, statistics array<double>")


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), N_STATISTICS)


@tidy
def _moment_batches(batches):
    n, one, two = 0, np.zeros(N_STATISTICS), np.zeros(N_STATISTICS)
    for batch in batches:
        x = _matrix(batch.column("statistics"))
        n, one, two = n + len(x), one + x.sum(axis=0), two + (x * x).sum(axis=0)
    yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([[n], one, two]).tobytes()], pa.binary())], ["sums"])


class Features:
    """Random Fourier features of standardised statistics, with a constant."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7, features: int = FEATURES):
        random = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.frequency = random.normal(size=(len(mean), features)) / np.sqrt(len(mean))
        self.phase = random.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        wave = np.sqrt(2 / len(self.phase)) * np.cos(z @ self.frequency + self.phase)
        return np.column_stack([np.ones(len(x)), wave])


@tidy
def _equation_batches(batches, features: Features):
    width = len(features.phase) + 1
    sums = np.zeros((2, width, width + 2))
    for batch in batches:
        x, y = features(_matrix(batch.column("statistics"))), np.asarray(batch.column("quality"), np.float64)
        half = np.asarray(batch.column("half"))
        for h in (0, 1):
            a, b = x[half == h], y[half == h]
            sums[h, :, :width] += a.T @ a
            sums[h, :, width] += a.T @ b
            sums[h, 0, width + 1] += len(a)
    yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], ["sums"])


def solve(sums: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    width = sums.shape[0]
    penalty = ridge * max(sums[0, width + 1], 1) / width * np.eye(width)
    penalty[0, 0] = 1e-9
    return np.linalg.solve(sums[:, :width] + penalty, sums[:, width])


@tidy
def _cross_batches(batches, features: Features, weights: tuple[np.ndarray, np.ndarray]):
    for batch in batches:
        x, half = features(_matrix(batch.column("statistics"))), np.asarray(batch.column("half"))
        score = np.where(half == 0, x @ weights[1], x @ weights[0])
        yield pa.RecordBatch.from_arrays([pa.array(score), batch.column("quality").cast(pa.float64())], ["score", "quality"])


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the best rising step function, pooled from adjacent violators: (mean score of a pool, its mean label).

    Rows of one score are one pool from the start, so the order of the rows doesn't matter.
    """
    values, of, rows = np.unique(score, return_inverse=True, return_counts=True)
    labels = np.bincount(of, label, len(values))
    pools: list[list[float]] = []  # [sum of labels, sum of scores, rows]
    for s, y, n in zip(values.tolist(), labels.tolist(), rows.tolist(), strict=True):
        pools.append([y, s * n, float(n)])
        while len(pools) > 1 and pools[-2][0] * pools[-1][2] >= pools[-1][0] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([s / n for _, s, n in pools]), np.array([y / n for y, _, n in pools])


class Model:
    """Scores statistics with a probability that the label is 1."""

    def __init__(self, features: Features, weights: np.ndarray, knots: tuple[np.ndarray, np.ndarray]):
        self.features, self.weights, self.knots = features, weights, knots

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        return np.clip(np.interp(self.features(x) @ self.weights, *self.knots), 0, 1)


def fit(labelled: DataFrame) -> Model | None:
    """Learns from (doc_id, statistics, quality 0 or 1); None without rows."""
    half = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)).cast("int").alias("half")
    rows = checkpointed(labelled.repartition(PARTITIONS, "doc_id").select("statistics", "quality", half))
    moments = sum((np.frombuffer(bytes(r[0]), np.float64) for r in rows.mapInArrow(_moment_batches, "sums binary").collect()), np.zeros(1 + 2 * N_STATISTICS))
    if not moments[0]:
        release(rows)
        return None
    count, one, two = moments[0], moments[1 : 1 + N_STATISTICS], moments[1 + N_STATISTICS :]
    mean = one / count
    features = Features(mean, np.sqrt(np.maximum(two / count - mean**2, 1e-6)))
    width = FEATURES + 1
    sums = sum(np.frombuffer(bytes(r[0]), np.float64) for r in rows.mapInArrow(partial(_equation_batches, features=features), "sums binary").collect())
    sums = sums.reshape(2, width, width + 2)
    halves = solve(sums[0]), solve(sums[1])
    crossed = rows.mapInArrow(partial(_cross_batches, features=features, weights=halves), "score double, quality double").toPandas()  # as many pairs as training rows
    release(rows)
    return Model(features, solve(sums[0] + sums[1]), isotonic(crossed["score"].to_numpy(), crossed["quality"].to_numpy()))


@tidy
def _score_batches(batches, model):
    for batch in batches:
        for part, texts in slices(batch, "text", 1 << 20):
            score = model.value(statistics(texts)) if model.value else np.full(len(part), 0.5)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score)], ["doc_id", "score"])


def learn_quality(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS) -> Model | None:
    """A model from the labels (doc_id, quality) of documents that are not held out.

    At most about `training_rows` labels, chosen by a hash of their ids, teach; only their texts are
    measured. They go out in a broadcast, which that number bounds. A repeated label teaches as often
    as it stands there, and so does a repeated document; contradicting labels both count.
    """
    taught = labels.filter("quality in (0, 1)").filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    taught = taught.select(F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("quality"))
    n, spread = taught.count(), 1_000_000
    if n > training_rows:
        taught = taught.filter(F.pmod(F.xxhash64("label_id", F.lit(3)), F.lit(spread)) < int(spread * training_rows / n))
    met = docs.select("doc_id", "text").join(F.broadcast(taught), F.col("doc_id") == F.col("label_id"))
    return fit(text_statistics(met.select("doc_id", "quality", "text"), ("doc_id", "quality")))


@tidy
def _filter_batches(batches, model, text: str):
    for batch in batches:
        for part, texts in slices(batch, text, 1 << 20):
            yield part.filter(pa.array(model.value(statistics(texts)) >= 0.5))


def keep_good(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows, with all columns, whose text scores 0.5 or more; all rows without a model. One narrow pass over the texts.

    Null and empty texts are scored like others; repeated rows stay or go together.
    """
    if model is None:
        return docs
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(partial(_filter_batches, model=sent, text=text), docs.schema)


def score_quality(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`; learned from `labels` (doc_id, quality) that are not held out.

    Null and empty texts are scored by their statistics, which are defined. Rows with a null id are
    scored and not held out; null labels and labels other than 0 and 1 teach nothing; repeated rows
    and equal texts get equal scores. Without a label to learn from every score is 0.5. Other columns
    are left out, whatever their names.
    """
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(learn_quality(docs, labels, training_rows))
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(partial(_score_batches, model=sent), f"doc_id {kind}, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
