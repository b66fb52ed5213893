"""Best-fit packing of documents into sequences by minimum bin slack.

1. Every text is tokenised once, and cut into pieces only if it is longer than a sequence; pieces
   (a few numbers each) are written to the shared folder.
2. What decides the packing is how many pieces there are of each length. That table has at most
   `capacity` rows at any size of input, so one process solves it: per bin, a subset-sum dynamic
   program over bitsets finds the fullest combination with the longest length left. The combination
   is taken as often as the counts allow, and removed. The plan has a few thousand rows.
3. Each piece takes the place that its rank among the pieces of its length gives it. Ranks are
   counted within (length, bucket) groups; a piece's bucket is a hash that was written with it, of
   its place in the table too, so a length, a key or a text that most pieces share is dealt over
   many tasks.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm._text import Recent, bounded_batches, checkpointed, slices, tidy
from tracewell.llm.bpe import LETTER, NUMBER, UNUSUAL, library, specials

#: The same split for the characters that bpe.UNUSUAL lets pass.
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^\\s{LETTER}{NUMBER}]+|\\s+(?!\\S)|\\s+")
LOOSE = re.compile(r" (?:\s|$)")  # spaces that don't lead a word
CAPACITY = 1024
BUCKETS = 64
ROWS_A_BUCKET = 20_000


@lru_cache(maxsize=1)
def merger(path: str):
    """The same byte-level merges in a quicker library; exact for texts without special tokens."""
    import json

    import tiktoken

    from tracewell.llm.bpe import byte_alphabet

    model, alphabet = json.load(open(path, encoding="utf-8"))["model"], byte_alphabet()
    marks = specials(path)
    ranks = {bytes(alphabet[c] for c in t): i for t, i in model["vocab"].items() if not marks.fullmatch(t)}
    #: The split pattern of this family of byte-level vocabularies, a fixed value.
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe


class ByteEncoder:
    """Ids of whole texts. A text is cut before each single space: no token of this vocabulary reaches across."""

    def __init__(self, path: str, words: int = 250_000):
        self.path, merge = path, merger(path).encode_single_piece

        def make(chunk: str) -> bytes:
            ids: list[int] = []
            for piece in PIECES.findall(chunk):
                ids += merge(piece.encode())
            return array("I", ids).tobytes()

        self.first, self.later = Recent(make, words // 8), Recent(lambda word: make(" " + word), words)

    def encode(self, text: str) -> bytes:
        if UNUSUAL.search(text) or specials(self.path).search(text):
            return array("I", library(self.path).encode(text, add_special_tokens=False).ids).tobytes()
        if LOOSE.search(text):
            return array("I", merger(self.path).encode_ordinary(text)).tobytes()
        parts, later = text.split(" "), self.later
        head = self.first[parts[0]] if parts[0] else b""
        return head + b"".join([later[w] for w in parts[1:]])


@lru_cache(maxsize=1)
def _byte_encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


@tidy
def _piece_batches(batches, path: str, text: str, end_id: int, capacity: int):
    encoder, end = _byte_encoder(path), array("I", [end_id]).tobytes()
    for batch in batches:
        for part, texts in slices(batch, text):
            rows, piece, start, length, ids = [], [], [], [], []
            for row, t in enumerate(texts.to_pylist()):
                got = encoder.encode(t) + end
                total = len(got) // 4
                first = (total - 1) % capacity + 1
                borders = [0, *range(first, total + 1, capacity)]
                for k, (a, b) in enumerate(zip(borders, borders[1:], strict=False)):
                    rows.append(row)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    ids.append(got[4 * a : 4 * b])
            key = part.column(0).take(pa.array(rows, pa.int64()))
            values = [pa.array(x, pa.int64()) for x in (start, length)]
            names = ["piece_key", "piece", "start", "length", "ids"]
            yield pa.RecordBatch.from_arrays([key, pa.array(piece, pa.int32()), *values, pa.array(ids, pa.binary())], names)


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, start, length, ids): each text's ids and `end_id`, cut to `capacity` if longer, the first piece being the short one."""
    bounded_batches(docs.sparkSession)
    kept = docs.select(key, text)
    kind = kept.schema[key].dataType.simpleString()
    run = partial(_piece_batches, path=path, text=text, end_id=end_id, capacity=capacity)
    return kept.mapInArrow(run, f"piece_key {kind}, piece int, start long, length long, ids binary").withColumnRenamed("piece_key", key)


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, how many) with the largest sum up to `room`, found by subset sums over bitsets; longer lengths are tried first."""
    mask, reached = (1 << (room + 1)) - 1, 1
    taken: list[tuple[int, int, int]] = []  # (length, copies, sums before)
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        left, copies = min(counts[length], room // length), 1
        while left and not reached >> room & 1:
            copies = min(copies, left)
            taken.append((length, copies, reached))
            reached |= reached << (length * copies) & mask
            left -= copies
            copies *= 2
        if reached >> room & 1:
            break
    total, out = reached.bit_length() - 1, {}
    for length, copies, before in reversed(taken):
        if not before >> total & 1:
            total -= length * copies
            out[length] = out.get(length, 0) + copies
    return sorted(out.items(), reverse=True)


def min_bin_slack(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(how many bins, [(length, how many)]) until no piece is left: each bin is the fullest one around the longest piece left."""
    counts = {x: n for x, n in counts.items() if n}
    if any(x > capacity or x < 1 for x in counts):
        raise ValueError("a length does not fit into a sequence")
    plan = []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        rest = fullest(counts, capacity - longest)
        counts[longest] += 1
        need = dict(rest)
        need[longest] = need.get(longest, 0) + 1
        times = min(counts[x] // k for x, k in need.items())
        for x, k in need.items():
            counts[x] -= k * times
            if not counts[x]:
                del counts[x]
        plan.append((times, sorted(need.items(), reverse=True)))
    return plan


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit, longest first, over a table of lengths: equal bins are filled together, so the work depends on the lengths alone."""
    groups: dict[int, list[tuple[int, dict[int, int]]]] = {}  # room left -> [(bins, {length: how many})]

    def put(room: int, bins: int, need: dict[int, int]) -> None:
        if bins:
            groups.setdefault(room, []).append((bins, need))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        for room in [*sorted(r for r in groups if r >= length), capacity]:  # the tightest first, new bins last
            each = room // length  # a bin that takes one is the tightest for the next
            opened = groups.pop(room, []) if room < capacity else [(-(-left // each), {})]
            for bins, need in opened:
                whole = min(bins, left // each)
                put(room - each * length, whole, {**need, length: each})
                left -= whole * each
                bins -= whole
                if bins and left:  # fewer than a bin takes
                    put(room - left * length, 1, {**need, length: left})
                    bins, left = bins - 1, 0
                put(room, bins, need)
    return [(bins, sorted(need.items(), reverse=True)) for room in sorted(groups) for bins, need in groups[room]]


def mended(plan: list[tuple[int, list[tuple[int, int]]]], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """The plan with its last bins packed anew: when only lengths are left that don't add up, short ones went too early.

    The bins with room and some of the latest full ones are taken apart and packed by best fit; the
    fewest bins win, the plan as it was among them.
    """
    room = [capacity - sum(x * k for x, k in need) for _, need in plan]
    open_bins = sum(times for (times, _), r in zip(plan, room, strict=True) if r)
    best = plan
    for share in (4, 16, 64):
        take, kept, counts = share * open_bins, [], {}
        for (times, need), r in zip(reversed(plan), reversed(room), strict=True):
            used = times if r else min(times, take)
            take -= 0 if r else used
            if times > used:
                kept.append((times - used, need))
            for x, k in need if used else []:
                counts[x] = counts.get(x, 0) + k * used
        found = [*reversed(kept), *best_fit(counts, capacity)]
        if sum(t for t, _ in found) < sum(t for t, _ in best):
            best = found
    return best


def _places(plan: Iterable[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, copies in a bin, first sequence, offset in the bin) in the order of ranks."""
    rows: dict[int, list] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for times, need in plan:
        offset = 0
        for length, copies in need:
            rows.setdefault(length, []).append((ranks.get(length, 0), copies, sequence, offset))
            ranks[length] = ranks.get(length, 0) + times * copies
            offset += length * copies
        sequence += times
    return {x: np.array(r, np.int64) for x, r in rows.items()}


@tidy
def _place_batches(batches, places: dict[int, np.ndarray]):
    for batch in batches:
        length = batch.column("length").to_numpy()
        rank = batch.column("rank").to_numpy()
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
            table, size = places[int(length[group[0]])], int(length[group[0]])
            at = np.searchsorted(table[:, 0], rank[group], side="right") - 1
            within, copies = rank[group] - table[at, 0], table[at, 1]
            sequence[group] = table[at, 2] + within // copies
            offset[group] = table[at, 3] + within % copies * size
        kept = [i for i, n in enumerate(batch.schema.names) if n != "rank"]
        names = [batch.schema.names[i] for i in kept]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])


def pack(table: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, deal: str | None = None) -> DataFrame:
    """Adds `sequence_id` and `offset` to a table of pieces (key, piece, start, length, and further columns).

    `deal` names a column of evenly spread whole numbers that buckets come from, which is left out of
    the result; without one, equal rows share a bucket. The table is read twice, so it must be a
    written one. Equal rows are interchangeable. An empty table gives an empty table.
    """
    counted = table.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most `capacity` rows
    counts = {r["length"]: r["n"] for r in counted}
    buckets = max(BUCKETS, -(-sum(counts.values()) // ROWS_A_BUCKET))
    places = _places(mended(min_bin_slack(counts, capacity), capacity))
    columns = [f for f in table.schema if f.name != deal]
    names = [f.name for f in columns]
    dealt = table.withColumn("bucket", F.pmod(F.col(deal) if deal else F.xxhash64(*names), F.lit(buckets)))
    sizes = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each length and bucket
    first = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_rank"))
    within = Window.partitionBy("length", "bucket").orderBy(key, "piece", *[c for c in names if c not in (key, "piece", "length")])
    ranked = dealt.withColumn("at", F.row_number().over(within)).join(F.broadcast(first) if capacity * buckets <= 1 << 20 else first, ["length", "bucket"])
    ranked = ranked.select(*names, (F.col("first_rank") + F.col("at") - 1).alias("rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
    return ranked.mapInArrow(partial(_place_batches, places=places), f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most `capacity` tokens.

    Columns: key, piece, start, length, ids_crc32 (unsigned, of the ids as little-endian unsigned
    32-bit integers), sequence_id, offset. A null or empty text is one piece of the end id alone.
    Repeated rows are packed as often as they appear; null keys are kept; columns other than key and
    text are left out, whatever their names; an empty table gives an empty table.
    """
    cut = pieces(docs, path, key, text, end_id, capacity)
    deal = F.pmod(F.xxhash64(key, "piece", "start", F.monotonically_increasing_id()), F.lit(1 << 31)).cast("int")
    table = checkpointed(cut.select(key, "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), deal.alias("deal")))
    return pack(table, key, capacity, "deal")
