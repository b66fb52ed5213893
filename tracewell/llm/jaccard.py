"""N-gram Jaccard join with Bayesian candidate pruning.

1. One pass over the texts: the set of word n-grams as 64-bit hashes, MinHash values, band keys.
   Texts with the same set are one copy class, met by an aggregation; its smallest key stands for it.
   A class is named by two hashes of its set.
2. Classes that share a band key, a bucket, are candidates. Each is tied to the least class of its
   bucket, so a bucket of m classes gives m - 1 rows, never m * m; ties make clusters.
3. A cluster is compared whole or bucket by bucket, whichever copies fewer rows: whole where buckets
   overlap much (copies of one text), by bucket where they form long chains. What is compared is cut
   into blocks of bounded size by hash, and every pair of its blocks is one group of rows. In a group,
   pairs that share no band are left out, or, in a bucket, those that an earlier band has; so either
   way the same pairs are compared, each once. MinHash values are compared sixteen at a time; a pair
   is dropped as soon as the posterior probability that its similarity reaches the threshold (uniform
   prior) is below the tolerance; the pairs left are verified exactly on their sets. A group puts out
   one row for each class with links (how many, and a class it hangs together with), not its pairs.
4. Link counts are summed, and the groups' ties give the classes of the join by components.
"""

from __future__ import annotations

from fractions import Fraction
from functools import lru_cache, partial
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm._text import bounded_batches, checkpointed, gram_hashes, kept_only, mix, release, slices, span_hashes, spent_tables, tidy, unused, view, with_size_check, word_spans
from tracewell.llm.components import connected_components

WORDS = 5
THRESHOLD = 0.8
TOLERANCE = 1e-6
HASHES, BANDS, ROWS = 128, 25, 5
STEP = 16
BLOCK_CLASSES, BLOCK_SHINGLES = 128, 500_000
ROWS_A_TASK = 2000

_RANDOM = np.random.default_rng(2024)
_FACTORS = _RANDOM.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_SHIFTS = _RANDOM.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int = WORDS) -> list[np.ndarray]:
    """For each text, the sorted distinct hashes of its k-word shingles; a text of fewer words is one shingle, none if it has no word."""
    starts, ends, first = word_spans(data, at)
    words = span_hashes(data, starts, ends)
    grams = gram_hashes(words, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        else:
            out.append(gram_hashes(words[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, one row of HASHES 32-bit numbers for each set; sets must not be empty."""
    out = np.empty((len(sets), HASHES), np.uint32)
    if not sets:
        return out
    short = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    begin = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    with np.errstate(over="ignore"):
        for j in range(HASHES):
            out[:, j] = np.minimum.reduceat(short * _FACTORS[j] + _SHIFTS[j], begin)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key for each row and band, of the lower halves of the band's values."""
    used = (signature[:, : BANDS * ROWS].astype(np.uint64) & np.uint64(0xFFFF)).reshape(len(signature), BANDS, ROWS)
    with np.errstate(over="ignore"):
        key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93)
        for r in range(ROWS):
            key = mix(key + used[:, :, r])
    return key.view(np.int64)


def _identity(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        one = [int(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)) for s in sets]
        two = [int(mix(s + np.uint64(0x1234567)).sum(dtype=np.uint64)) for s in sets]
    return np.array(one, np.uint64).view(np.int64), np.array(two, np.uint64).view(np.int64)


@tidy
def _profile_batches(batches, k: int):
    for batch in batches:
        for part, texts in slices(batch, "text"):
            sets = shingle_sets(*view(texts), k)
            full = [i for i, s in enumerate(sets) if len(s)]
            chosen = [sets[i] for i in full]
            one, two = _identity(chosen)
            keys = band_keys(signatures(chosen))
            offsets = pa.array(np.arange(0, BANDS * len(full) + 1, BANDS, dtype=np.int32))
            bands = pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))
            doc, version = (part.column(n).take(pa.array(full, pa.int64())) for n in ("doc", "version"))
            size = pa.array([len(s) for s in chosen], pa.int32())
            yield pa.RecordBatch.from_arrays([doc, version, size, pa.array(one), pa.array(two), bands], ["doc", "version", "size", "one", "two", "bands"])


@tidy
def _member_batches(batches, k: int):
    for batch in batches:
        for part, texts in slices(batch, "text"):
            sets = shingle_sets(*view(texts), k)
            one, two = _identity(sets)
            same = np.array([len(s) > 0 for s in sets]) & (one == part.column("one").to_numpy()) & (two == part.column("two").to_numpy())
            full = np.flatnonzero(same)
            chosen = [sets[i] for i in full]
            short = (signatures(chosen) & np.uint32(0xFFFF)).astype(np.uint16)
            kept = part.take(pa.array(full))
            names = ["one", "two", "cluster", "copies", "units"]
            new = [pa.array([row.tobytes() for row in short], pa.binary()), pa.array([s.tobytes() for s in chosen], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(kept.column(n) for n in names), *new], [*names, "signature", "shingles"])


@lru_cache(maxsize=4)
def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For STEP, 2 * STEP, ... compared values: the fewest equal ones at which the posterior of reaching the threshold is not below the tolerance."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, 0
        while True:  # with a uniform prior: P(similarity >= t | m of n) = P(Binomial(n + 1, t) <= m)
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def candidate_pairs(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, threshold: Fraction, tolerance: float, upper: bool, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with a common band (`band` < 0) or with `band` as the first, that the sizes allow and the incremental comparison of MinHash values keeps; upper: only i < j."""
    p, q = threshold.numerator, threshold.denominator
    low, high = np.minimum(size_a[:, None], size_b[None, :]), np.maximum(size_a[:, None], size_b[None, :])
    alive = low * q >= high * p
    if upper:
        alive &= np.arange(len(a))[:, None] < np.arange(len(b))[None, :]
    keys_a, keys_b = band_keys(a), band_keys(b)
    common = lambda k: keys_a[:, k, None] == keys_b[None, :, k]
    if band < 0:
        alive &= np.logical_or.reduce([common(k) for k in range(BANDS)])
    else:
        alive &= common(band)
        for k in range(band):
            alive &= ~common(k)
    least = least_matches(float(threshold), tolerance)
    i, j = np.nonzero(alive)
    matches = np.zeros(len(i), np.int16)
    for step, m in enumerate(least):
        if not len(i):
            break
        columns = slice(step * STEP, (step + 1) * STEP)
        for at in range(0, len(i), 1 << 17):
            part = slice(at, at + (1 << 17))
            matches[part] += (a[i[part], columns] == b[j[part], columns]).sum(axis=1, dtype=np.int16)
        keep = matches >= m
        i, j, matches = i[keep], j[keep], matches[keep]
    return i, j


def common_counts(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sorted sets a[i] and b[j]."""
    if len(i) <= 4 * (len(a) + len(b)):
        out = np.empty(len(i), np.int64)
        for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            one, two = (a[x], b[y]) if len(a[x]) <= len(b[y]) else (b[y], a[x])
            at = np.searchsorted(two, one)
            at[at == len(two)] = 0
            out[k] = np.count_nonzero(two[at] == one)
        return out
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(np.unique(flat_a), np.unique(flat_b), assume_unique=True)
    total = np.zeros((len(a), len(b)), np.float32)

    def cells(flat, sets):
        column = np.searchsorted(shared, flat)
        column[column == len(shared)] = 0
        hit = shared[column] == flat if len(shared) else np.zeros(len(flat), bool)
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[hit]
        column = column[hit]
        order = np.argsort(column, kind="stable")
        return row[order], column[order]

    (row_a, col_a), (row_b, col_b) = cells(flat_a, a), cells(flat_b, b)
    width = 2048
    for at in range(0, len(shared), width):
        wide = min(width, len(shared) - at)
        left, right = np.zeros((len(a), wide), np.float32), np.zeros((len(b), wide), np.float32)
        for matrix, row, col in ((left, row_a, col_a), (right, row_b, col_b)):
            part = slice(np.searchsorted(col, at), np.searchsorted(col, at + wide))
            matrix[row[part], col[part] - at] = 1
        total += left @ right.T
    return total[i, j].astype(np.int64)


def linked(a: list[tuple], b: list[tuple] | None, threshold: Fraction, tolerance: float, band: int) -> list[tuple]:
    """(class, documents it is linked to, a class it hangs together with) in one group of rows (class, copies, signature, set)."""
    other = a if b is None else b
    sign = [np.frombuffer(b"".join([x[2] for x in side]), np.uint16).reshape(len(side), HASHES) for side in (a, other)]
    sets = [[np.frombuffer(x[3], np.uint64) for x in side] for side in (a, other)]
    sizes = [np.array([len(s) for s in side], np.int64) for side in sets]
    i, j = candidate_pairs(*sign, *sizes, threshold, tolerance, b is None, band)
    if not len(i):
        return []
    common = common_counts(*sets, i, j)
    union = sizes[0][i] + sizes[1][j] - common
    keep = common * threshold.denominator >= union * threshold.numerator
    i, j = i[keep], j[keep]
    shift = 0 if b is None else len(a)
    nodes = a if b is None else [*a, *b]
    copies = np.array([x[1] for x in nodes], np.int64)
    j = j + shift
    links = np.bincount(i, copies[j], len(nodes)) + np.bincount(j, copies[i], len(nodes))
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        if (new == root).all():
            break
        root = new
    return [(*nodes[x][0], int(links[x]), *nodes[root[x]][0]) for x in np.flatnonzero(links)]


LINKS = "one long, two long, links long, root_one long, root_two long"


@tidy
def _group_batches(batches, threshold: Fraction, tolerance: float):
    """Rows come sorted by (cluster, band, bucket, low, high, block, class), each group of the first five whole in a task."""
    key, sides, found = None, {}, []

    def finish():
        if key is None:
            return
        band, low, high = key[2], key[4], key[5]
        if low == high:
            found.extend(linked(sides[low], None, threshold, tolerance, band) if len(sides[low]) > 1 else [])
        elif low in sides and high in sides:
            found.extend(linked(sides[low], sides[high], threshold, tolerance, band))

    def rows():
        arrays = [pa.array([x[c] for x in found], pa.int64()) for c in range(5)]
        found.clear()
        return pa.RecordBatch.from_arrays(arrays, ["one", "two", "links", "root_one", "root_two"])

    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("cluster_one", "cluster_two", "band", "bucket", "low", "high", "block", "one", "two", "copies", "signature", "shingles")]
        for *group, block, one, two, copies, signature, shingles in zip(*columns, strict=True):
            if key != group:
                finish()
                key, sides = group, {}
            side = sides.setdefault(block, [])
            if not side or side[-1][0] != (one, two):  # rows with one key and one text give a class several times
                side.append(((one, two), copies, signature, shingles))
        yield rows()
    finish()
    yield rows()


def _blocks(n: str, total: str):
    return F.greatest(F.ceil(F.col(n) / BLOCK_CLASSES), F.ceil(F.col(total) / BLOCK_SHINGLES)).cast("int")


def _joined(docs: DataFrame, key: str, text: str, words: int, threshold: float, tolerance: float) -> DataFrame:
    """(doc, version, class_id, copy_id, n_links, stays) of each row: `version` is a hash of its text, `stays` the least (doc, version) of its class."""
    bounded_batches(docs.sparkSession)
    exact = Fraction(threshold).limit_denominator(1000)
    known = docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(text).alias("version"), F.col(text).alias("text")).filter("doc is not null")
    profile = checkpointed(known.mapInArrow(partial(_profile_batches, k=words), "doc long, version long, size int, one long, two long, bands array<long>"))
    classes = checkpointed(
        profile.groupBy("one", "two", "size").agg(F.min(F.struct("doc", "version")).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
    )
    node = F.struct("one", "two")
    keys = checkpointed(classes.select(node.alias("node"), "size", F.posexplode("bands").alias("band", "bucket")))
    buckets = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total")).filter("n > 1")
    met = checkpointed(keys.join(buckets.select("bucket", _blocks("n", "total").alias("blocks")).hint("merge"), "bucket").drop("size"))
    release(keys)
    least = met.groupBy("bucket").agg(F.min("node").alias("least"))
    ties = met.select("bucket", "node").join(least.hint("merge"), "bucket").filter("node <> least")
    clusters = connected_components(ties.select(F.col("node").alias("a"), F.col("least").alias("b")))
    members = clusters.select("node.*", F.col("component").alias("cluster")).join(classes.drop("bands"), ["one", "two"])
    members = checkpointed(members)
    placed = met.join(clusters.select("node", F.col("component").alias("cluster")), "node")
    apart = placed.groupBy("cluster").agg(F.sum("blocks").alias("apart"))  # rows if it is compared by bucket
    whole = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))
    whole = whole.select("cluster", _blocks("n", "total").alias("blocks"), "n", (F.col("n") * _blocks("n", "total")).alias("whole"))
    ways = checkpointed(whole.join(apart, "cluster").withColumn("by_bucket", F.col("apart") < F.col("whole")))
    unit = lambda band, bucket, blocks: F.struct(band.cast("int").alias("band"), bucket.cast("long").alias("bucket"), blocks.alias("blocks"))
    columns = ("one", "two", "cluster", "rep", "copies")
    one = members.join(ways.filter("not by_bucket").select("cluster", "blocks"), "cluster")
    one = one.select(*columns, F.array(unit(F.lit(-1), F.lit(0), F.col("blocks"))).alias("units"))
    many = placed.join(ways.filter("by_bucket").select("cluster"), "cluster", "left_semi")
    many = many.groupBy("node").agg(F.collect_list(unit(F.col("band"), F.col("bucket"), F.col("blocks"))).alias("units"))  # at most BANDS
    sized = one.unionByName(members.join(many.select("node.*", "units"), ["one", "two"]).select(*columns, "units"))
    counted = ways.agg(F.sum("n").alias("members"), F.sum(F.least("apart", "whole")).alias("rows")).first()
    n_rows = counted["rows"] or 0
    read = known.join(with_size_check(sized, 1, 96 * (counted["members"] or 0) + 24 * n_rows), (known["doc"] == sized["rep.doc"]) & (known["version"] == sized["rep.version"]))
    units = "array<struct<band: int, bucket: long, blocks: int>>"
    filled = read.select("text", "one", "two", "cluster", "copies", "units").mapInArrow(
        partial(_member_batches, k=words), f"one long, two long, cluster struct<one: long, two: long>, copies long, units {units}, signature binary, shingles binary"
    )
    paired = filled.withColumn("unit", F.explode("units")).withColumn("block", F.pmod(F.xxhash64("one", "two"), F.col("unit.blocks")).cast("int"))
    paired = paired.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("unit.blocks") - 1)))
    group = (F.col("cluster.one").alias("cluster_one"), F.col("cluster.two").alias("cluster_two"), "unit.band", "unit.bucket")
    paired = paired.select(*group, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "one", "two", "copies", "signature", "shingles")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // ROWS_A_TASK))
    names = ["cluster_one", "cluster_two", "band", "bucket", "low", "high"]
    dealt = paired.repartition(parts, *names).sortWithinPartitions(*names, "block", "one", "two")
    found = checkpointed(dealt.mapInArrow(partial(_group_batches, threshold=exact, tolerance=tolerance), LINKS))
    release(members, met, ways)
    links = found.groupBy("one", "two").agg(F.sum("links").alias("links"))
    roots = F.struct(F.col("root_one").alias("one"), F.col("root_two").alias("two"))
    joined = connected_components(found.select(node.alias("a"), roots.alias("b")).filter("a <> b"))
    joined = joined.select("node.*", "component").join(classes.select("one", "two", "rep"), ["one", "two"])
    least = joined.groupBy("component").agg(F.min("rep").alias("stays"))
    joined = joined.join(least, "component").select("one", "two", "stays")
    named = classes.select("one", "two", "rep", "copies").join(links, ["one", "two"], "left").join(joined, ["one", "two"], "left")
    named = named.select("one", "two", F.col("rep.doc").alias("copy_id"), F.coalesce("stays", "rep").alias("stays"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    named = checkpointed(named)  # so that the join below meets two exchanges, which Spark splits where one text is hot
    ids = profile.join(named.hint("merge"), ["one", "two"]).select("doc", "version", F.col("stays.doc").alias("class_id"), "copy_id", "n_links", "stays")
    bare = docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(text).alias("version"), F.col(text).alias("bare")).filter(F.col("doc").isNull() | ~F.coalesce(F.col("bare"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]"))
    bare = bare.select("doc", "version", F.col("doc").alias("class_id"), F.col("doc").alias("copy_id"), F.lit(0).cast("long").alias("n_links"), F.struct("doc", "version").alias("stays"))
    return ids.unionByName(bare)


def jaccard_join(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE
) -> DataFrame:
    """One row for each document: key, `class_id`, `copy_id`, `n_links`.

    Two documents are linked if the Jaccard similarity of their sets of `words`-word shingles is at
    least `threshold` (copies are linked). `n_links` counts a document's links, `copy_id` is the
    smallest key among documents with the same set, `class_id` the smallest among all that links
    connect. A pair at the threshold is missed with a probability of about 5e-5 (bands) plus the
    tolerance; no pair below the threshold is ever linked.

    Words are runs without bytes 9-13 and 32, unchanged. A text of fewer words is one shingle; a null
    or empty text has none and no links. Every row is a document: repeated rows count as copies, and
    rows with one key and different texts are joined each by its own text. Rows with a null key have
    null ids and no links. Keys are integers; columns other than key and text are left out, whatever
    their names. An empty table gives an empty table.
    """
    with spent_tables() as made:
        found = _joined(docs, key, text, words, threshold, tolerance)
        return kept_only(made, found.select(F.col("doc").alias(key), "class_id", "copy_id", "n_links"))


def one_of_each(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE
) -> DataFrame:
    """The rows of `docs`, all columns, with one document left of each class of `jaccard_join`: the one of the smallest key.

    Of rows with one key that links connect, the text with the smallest hash stays; of equal rows, one
    (whichever, if they differ in further columns). Documents without a word are no copies of others;
    rows with a null key all stay. An empty table gives an empty table.
    """
    with spent_tables() as made:
        found = _joined(docs, key, text, words, threshold, tolerance).filter("doc is not null")
        rows = checkpointed(found.select("doc", "version", (F.struct("doc", "version") == F.col("stays")).alias("first")))
        counted = rows.groupBy("doc", "version", "first").agg(F.count(F.lit(1)).alias("n"))
        marked = kept_only(made, counted.filter("n > 1 or not first"))
    name = {c: unused(c, docs.columns) for c in ("doc", "version", "first", "n")}
    marked = marked.select(*(F.col(c).alias(x) for c, x in name.items()))
    n = marked.count()
    if not n:
        return docs
    same = (F.col(key).cast("long") == F.col(name["doc"])) & (F.xxhash64(text) == F.col(name["version"]))
    kept = docs.join(with_size_check(marked, n, 32), same, "left_anti")
    often = marked.filter(F.col(name["first"]))
    if often.isEmpty():
        return kept
    once = docs.join(often, same, "left_semi").dropDuplicates([key, text])
    return kept.unionByName(once)
