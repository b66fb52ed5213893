"""Exact top-k search by inner product over norm buckets.

Vectors are grouped by length: a bucket holds the vectors whose norms lie within one step of a
geometric scale, cut by hash into blocks of bounded size (all vectors may have one length). Queries
go out in blocks of bounded size, each with a threshold: its k-th best product with a fixed number
of the longest vectors, which every better result has to reach. For a query and a block, threshold
and lengths give a local cosine threshold. If even the longest vector of the block needs more than
1, the block is skipped; if the local threshold is high, candidates are pruned by coordinates (the
feasible range of the query's largest coordinates), else by length (a prefix of the block sorted by
norm). What is left is verified by exact integer products: in doubles where all sums stay below 2^53,
in whole numbers of any size beyond.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm._text import bounded_batches, checkpointed, release, tidy

K = 10
SCALE = 1024
LONGEST = 2048
STEP = 1.05
BLOCK = 4096
QUERY_BYTES = 32 << 20
HIGH = 0.75
COORDINATES = 3


def length(vector: np.ndarray) -> float:
    largest = np.abs(vector).max()
    if largest < 1e100:
        return float(np.sqrt(vector @ vector))
    return float(largest * np.sqrt(((vector / largest) ** 2).sum()))


@tidy
def _integer_batches(batches, scale: int):
    for batch in batches:
        vectors = batch.column("embedding")
        ok = np.array(vectors.is_valid()) & np.array(batch.column("vec_id").is_valid())
        lengths = np.array(pa.compute.fill_null(pa.compute.list_value_length(vectors), 0))
        flat = vectors.flatten()  # of the valid lists
        with np.errstate(over="ignore", invalid="ignore"):
            values = np.floor(flat.cast(pa.float64()).to_numpy(zero_copy_only=False) * scale)  # a null becomes NaN
        taken = np.where(np.array(vectors.is_valid()), lengths, 0)
        bounds = np.concatenate([[0], np.cumsum(taken)])
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
        ok &= (bad[bounds[1:]] == bad[bounds[:-1]]) & (taken > 0)
        rows = np.flatnonzero(ok)
        parts = [values[bounds[r] : bounds[r + 1]] for r in rows]
        norm = np.array([length(p) for p in parts])
        ids = batch.column("vec_id").take(pa.array(rows)).cast(pa.int64())
        size = pa.array([len(p) for p in parts], pa.int32())
        data = pa.array([p.astype("<f8").tobytes() for p in parts], pa.binary())
        yield pa.RecordBatch.from_arrays([ids, size, pa.array(norm), data], ["vec_id", "dims", "norm", "vector"])


class Queries:
    """A block of queries of one width with the score that each has to reach."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, least: np.ndarray):
        self.ids, self.matrix, self.least = ids, matrix, least
        self.norm = np.array([length(v) for v in matrix])
        unit = matrix / np.maximum(self.norm, 1e-12)[:, None]
        self.focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :COORDINATES]
        self.angle = np.arccos(np.clip(np.take_along_axis(unit, self.focus, axis=1), -1, 1))


def exact_products(matrix: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers with another, as Python integers."""
    numbers = [int(x) for x in query]
    return np.array([sum(int(x) * y for x, y in zip(row, numbers, strict=True)) for row in matrix.tolist()], object)


def best_of_block(queries: Queries, ids: np.ndarray, matrix: np.ndarray, norm: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vec_id, score): for each query its k best of one block that reach its least score, the query itself left out."""
    order = np.argsort(-norm, kind="stable")
    ids, matrix, norm = ids[order], matrix[order], norm[order]
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        slack = 1e-9 * (1 + np.abs(queries.least))
        reach = queries.norm * norm[0]
        go = np.flatnonzero(reach + slack >= queries.least)  # else no vector of the block is long enough
        local = np.where(reach[go] > 0, (queries.least[go] - slack[go]) / reach[go], -1)
        needed = np.where(queries.norm[go] > 0, (queries.least[go] - slack[go]) / queries.norm[go], 0)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def keep(row: int, at: np.ndarray, score: np.ndarray) -> None:
        if exact := reach[row] < 1 << 53:  # bounds every sum on the way, too
            good = (score >= queries.least[row]) & (ids[at] != queries.ids[row])
            at, score = at[good], score[good]
        else:
            at = at[ids[at] != queries.ids[row]]
            score = np.clip(exact_products(matrix[at], queries.matrix[row]), -(1 << 63), (1 << 63) - 1)
        if len(at) > k:
            if exact:
                border = -np.partition(-score, k - 1)[k - 1]
            else:
                border = sorted(score, reverse=True)[k - 1]
            sure, tied = np.flatnonzero(score > border), np.flatnonzero(score == border)
            tied = tied[np.argsort(ids[at[tied]], kind="stable")][: k - len(sure)]
            chosen = np.concatenate([sure, tied])
            at, score = at[chosen], score[chosen]
        found.append((np.full(len(at), row), ids[at], score.astype(np.int64)))

    by_coordinates = local > HIGH
    unit = matrix / np.maximum(norm, 1e-12)[:, None] if by_coordinates.any() else None
    for row, t in zip(go[by_coordinates], np.minimum(local[by_coordinates], 1), strict=True):
        inside = np.ones(len(ids), bool)
        wide = np.arccos(t)  # an angle between two vectors bounds the difference of their angles to any axis
        for c, angle in zip(queries.focus[row], queries.angle[row], strict=True):
            inside &= unit[:, c] >= np.cos(min(np.pi, angle + wide)) - 1e-7
            inside &= unit[:, c] <= np.cos(max(0.0, angle - wide)) + 1e-7
        at = np.flatnonzero(inside)
        keep(row, at, matrix[at] @ queries.matrix[row])
    by_length = go[~by_coordinates]
    ends = np.searchsorted(-norm, -needed[~by_coordinates], side="right")
    for start in range(0, len(by_length), 256):
        rows = by_length[start : start + 256]
        last = ends[start : start + 256]
        with np.errstate(over="ignore", invalid="ignore"):
            scores = queries.matrix[rows] @ matrix[: last.max()].T
        for row, end, score in zip(rows, last, scores, strict=True):
            keep(row, np.arange(end), score[:end])
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


@tidy
def _search_batches(batches, queries, k: int):
    """Rows of one block come together (sorted); blocks are flushed at BLOCK rows or when the bucket changes."""
    held: list[tuple] = []
    bucket = None
    blocks: dict[int, Queries] = queries.value

    def search():
        dims = held[0][1]
        block = blocks.get(dims)
        if block is None:
            return None
        ids, norm = np.array([h[0] for h in held], np.int64), np.array([h[2] for h in held])
        matrix = np.frombuffer(b"".join([h[3] for h in held]), "<f8").reshape(len(held), dims)
        row, vec, score = best_of_block(block, ids, matrix, norm, k)
        arrays = [pa.array(block.ids[row.astype(np.int64)]), pa.array(vec.astype(np.int64)), pa.array(score)]
        return pa.RecordBatch.from_arrays(arrays, ["query_id", "vec_id", "score"])

    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("vec_id", "dims", "norm", "vector", "bucket")]
        for row in zip(*columns, strict=True):
            if held and (row[4] != bucket or row[1] != held[0][1] or len(held) >= BLOCK):
                if (out := search()) is not None:
                    yield out
                held = []
            bucket = row[4]
            held.append(row)
    if held and (out := search()) is not None:
        yield out


def _matrix(rows, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join([bytes(r["vector"]) for r in rows]), "<f8").reshape(len(rows), dims)


def _least_scores(matrix: np.ndarray, ids: np.ndarray, seeds: np.ndarray, seed_ids: np.ndarray, k: int) -> np.ndarray:
    """For each query its k-th best product with the seeds, which are no better than all candidates; -1e300 without so many."""
    least = np.full(len(ids), -1e300)
    if len(seeds) <= k:
        return least
    for at in range(0, len(ids), 512):
        part = slice(at, at + 512)
        with np.errstate(over="ignore", invalid="ignore"):
            scores = matrix[part] @ seeds.T
        scores = np.where((ids[part, None] == seed_ids[None, :]) | np.isnan(scores), -np.inf, scores)
        least[part] = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
    return np.where(np.isfinite(least), least, -1e300)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products over all other vectors, ties to the smaller vec_id.

    Both tables have vec_id (an integer) and embedding (an array of numbers); a component x counts as
    floor(scale * x). Vectors that are null or empty, or hold a null or a component that is not
    finite (scaled, too), and rows with a null id take no part; vectors of another width than a
    query's are no candidates of it. A row with the query's own id is no candidate. Repeated
    candidates count as often as they appear; of queries with one id the one whose numbers come first
    in byte order is asked. Fewer than k candidates give fewer rows. Products are exact at any size;
    one beyond a long counts as the nearest long. Other columns are left out, whatever their names.

    Queries are searched in blocks of QUERY_BYTES, one after another: a block goes out in a broadcast
    that is gone before the next one, and meets every candidate in one scan, so what the driver and
    an executor hold is bounded, and a block's result is written at once.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    schema = "vec_id long, dims int, norm double, vector binary"
    whole = lambda df: df.select("vec_id", "embedding").mapInArrow(partial(_integer_batches, scale=scale), schema)
    candidates = checkpointed(whole(vectors))
    one = whole(queries).groupBy("vec_id").agg(F.min(F.struct("vector", "dims")).alias("q"))
    asked = checkpointed(one.select("vec_id", "q.dims", "q.vector"))
    widths = asked.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).collect()  # one row for each width of vector
    bucket = F.floor(F.log(F.greatest("norm", F.lit(1e-9))) / F.lit(float(np.log(STEP)))).cast("long")
    # one sort per task groups its rows by length class; nothing is shuffled, so no length is a hot key
    dealt = candidates.withColumn("bucket", bucket).sortWithinPartitions(F.desc("dims"), F.desc("bucket"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    results = []
    for width in widths:
        dims = width["dims"]
        n_blocks = -(-width["n"] * 8 * dims // QUERY_BYTES)
        longest = candidates.filter(F.col("dims") == dims).orderBy(F.desc("norm"), "vec_id").limit(LONGEST).collect()  # LONGEST rows at any size
        seeds, seed_ids = _matrix(longest, dims), np.array([r["vec_id"] for r in longest], np.int64)
        for number in range(n_blocks):
            chosen = asked.filter((F.col("dims") == dims) & (F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == number)).collect()  # a block
            if not chosen:
                continue
            matrix, ids = _matrix(chosen, dims), np.array([r["vec_id"] for r in chosen], np.int64)
            sent = spark.sparkContext.broadcast({dims: Queries(ids, matrix, _least_scores(matrix, ids, seeds, seed_ids, k))})
            found = dealt.mapInArrow(partial(_search_batches, queries=sent, k=k), "query_id long, vec_id long, score long")
            ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            results.append(checkpointed(ranked.select("query_id", "rank", "vec_id", "score")))
            sent.destroy()
    release(candidates, asked)
    if not results:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return spark.read.schema(results[0].schema).parquet(*[r.written_at for r in results])
