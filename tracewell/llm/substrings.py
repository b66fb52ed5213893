"""Substring dedup: words of repeated passages, by suffix automata of reference shards.

A window is `size` consecutive words. A window is removed if its words also start earlier: in a
smaller document, or earlier in the same one. A corpus can't be broadcast as one automaton, so the
reference is cut into shards that need only themselves:

1. Each text is streamed once. The windows that share one minimizer (the word 5-gram with the least
   hash in the window) form a segment of a few windows. Equal windows have equal minimizers, so all
   that can repeat a window stands in segments of its minimizer. Segments are rows of numbers.
2. Segments whose minimizer appears once anywhere repeat nothing and go. The rest fall into classes
   of equal content; a class keeps its earliest place (pre-aggregated, so a passage that a third of
   all rows share is one row). Minimizers with more than `hot` classes are cut to single windows.
3. The classes of a minimizer that has several are a reference shard: their words are dealt by the
   minimizer. Each shard builds a suffix automaton over its classes in the order of their places and
   streams each class against what came before it: a matching statistic of `size` or more words marks
   a window that starts earlier.
4. Windows of later places of a class, and marked windows of its earliest, give spans of words;
   overlapping spans join into maximal ones, which are removed.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm._text import bounded_batches, checkpointed, gram_hashes, kept_only, mix, release, slices, span_hashes, spent_tables, tidy, unused, view, word_spans

SIZE = 20
GRAM = 5
HOT = 400
SHARD_CLASSES = 4_000

SEGMENTS = "doc long, version long, start int, windows int, anchor long, content long"


def _minimizers(order: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least value in each run of `width` values."""
    at, best, reach = np.arange(len(order)), order, 1
    while reach < width:
        step = min(reach, width - reach)
        n = len(best) - step
        right = best[step:] < best[:n]
        at, best = np.where(right, at[step:], at[:n]), np.where(right, best[step:], best[:n])
        reach += step
    return at


def segments_of(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """(text, start word in the text, windows, anchor hash, content hash) of all segments; `first` has the first word of each text."""
    n = len(words)
    if n < size:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.int64),) * 2
    gram = min(GRAM, size)
    grams = gram_hashes(words, gram)
    least = _minimizers(grams, size - gram + 1)  # for each window start
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(least)]
    inside = np.arange(len(least)) + size <= first[1:][text]
    starts = np.flatnonzero(inside)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.int64),) * 2
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(starts) != 1) | (np.diff(least[starts]) != 0) | (np.diff(text[starts]) != 0)
    begin = np.flatnonzero(new)
    windows = np.diff(np.append(begin, len(starts)))
    at = starts[begin]
    whole = gram_hashes(words, size)
    with np.errstate(over="ignore"):
        content = mix(whole[at] * np.uint64(3) + whole[at + windows - 1] * np.uint64(5) + windows.astype(np.uint64))
    return text[at], at - first[text[at]], windows, grams[least[at]].view(np.int64), content.view(np.int64)


@tidy
def _segment_batches(batches, text: str, size: int):
    for batch in batches:
        for part, texts in slices(batch, text):
            data, at = view(texts)
            starts, ends, first = word_spans(data, at)
            owner, start, windows, anchor, content = segments_of(span_hashes(data, starts, ends), first, size)
            row = pa.array(owner, pa.int64())
            arrays = [part.column("doc").take(row), part.column("version").take(row), pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(anchor), pa.array(content)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc", "version", "start", "windows", "anchor", "content"])


@tidy
def _content_batches(batches, text: str, size: int):
    """The word hashes of the asked segments of each text: one row for each segment."""
    for batch in batches:
        for part, texts in slices(batch, text):
            data, at = view(texts)
            starts, ends, first = word_spans(data, at)
            words = span_hashes(data, starts, ends).view(np.int64)
            asked = part.column("asked")
            count = np.diff(asked.offsets.to_numpy())
            if not count.sum():
                continue
            owner = np.repeat(np.arange(len(part)), count)
            flat = asked.flatten()
            get = {f.name: flat.field(i) for i, f in enumerate(flat.type)}
            begin = first[owner] + get["start"].to_numpy()
            end = np.minimum(begin + get["windows"].to_numpy() + size - 1, first[owner + 1])
            rows = [words[a:b].tobytes() for a, b in zip(begin, end, strict=True)]
            doc = part.column("doc").take(pa.array(owner, pa.int64()))
            yield pa.RecordBatch.from_arrays([doc, get["start"], get["windows"], get["anchor"], get["content"], pa.array(rows, pa.binary())], ["doc", "start", "windows", "anchor", "content", "words"])


class SuffixAutomaton:
    """A suffix automaton over several sequences of integers."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def extend(self, last: int, symbol: int) -> int:
        """Adds `symbol` after the state `last` (0 begins a new sequence); the state of the longer sequence."""
        nexts, link, length = self.next, self.link, self.length
        known = nexts[last].get(symbol)
        if known is not None and length[known] == length[last] + 1:
            return known
        if known is None:
            here = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
        p = last
        while known is None and p >= 0 and symbol not in nexts[p]:
            nexts[p][symbol] = here
            p = link[p]
        if p < 0:
            return here
        q = nexts[p][symbol]
        if length[q] == length[p] + 1:
            if known is None:
                link[here] = q
                return here
            return q
        clone = len(nexts)
        nexts.append(dict(nexts[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p >= 0 and nexts[p].get(symbol) == q:
            nexts[p][symbol] = clone
            p = link[p]
        if known is None:
            link[here] = clone
            return here
        return clone

    def matching(self, sequence: list[int]) -> list[int]:
        """For each position, the length of the longest match that ends there."""
        nexts, link, length = self.next, self.link, self.length
        state, matched, out = 0, 0, []
        for symbol in sequence:
            while state and symbol not in nexts[state]:
                state = link[state]
                matched = length[state]
            state = nexts[state].get(symbol, 0)
            matched = matched + 1 if state else 0
            out.append(matched)
        return out

    def add(self, sequence: list[int]) -> None:
        state = 0
        for symbol in sequence:
            state = self.extend(state, symbol)


def earlier_windows(sequences: list[list[int]], size: int) -> list[int]:
    """For each sequence, in order, a bitmask of its windows that an earlier sequence holds."""
    automaton, out = SuffixAutomaton(), []
    for sequence in sequences:
        mask = 0
        for end, matched in enumerate(automaton.matching(sequence)):
            if matched >= size:
                mask |= 1 << (end + 1 - size)
        out.append(mask)
        automaton.add(sequence)
    return out


@tidy
def _shard_batches(batches, size: int):
    """Rows come sorted by (anchor, doc, start), all of an anchor in one task: a shard, with an automaton of its own."""
    held: list[tuple] = []

    def flush():
        if not held:
            return None
        masks = earlier_windows([np.frombuffer(w, np.int64).tolist() for _, _, w in held], size)
        arrays = [pa.array([h[1] for h in held], pa.int64()), pa.array([h[0] for h in held], pa.int64()), pa.array(masks, pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, ["content", "anchor", "earlier"])

    key = None
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("anchor", "content", "words")]
        out = []
        for row in zip(*columns, strict=True):
            if row[0] != key:
                if (done := flush()) is not None:
                    out.append(done)
                held, key = [], row[0]
            held.append(row)
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
    if (done := flush()) is not None:
        yield done


def removal_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, hot: int = HOT) -> DataFrame:
    """(doc, version, start, windows, removed): which windows to remove, `start` in words of the whole text, `version` a hash of the text.

    Bit i of `removed` is the window at start + i; a window covers `size` words.
    """
    if not 2 <= size <= 62:
        raise ValueError("a window has 2 to 62 words")
    bounded_batches(docs.sparkSession)
    known = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.xxhash64(F.col(text)).alias("version"), F.col(text).alias("text"))
    segments = checkpointed(known.mapInArrow(partial(_segment_batches, text="text", size=size), SEGMENTS))
    repeated = checkpointed(segments.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"))
    kept = checkpointed(segments.join(repeated.hint("merge"), "anchor", "left_semi"))
    release(segments, repeated)
    # classes of equal content, each with its earliest place
    first = kept.groupBy("anchor", "content", "windows").agg(F.min(F.struct("doc", "start", "version")).alias("first"))
    first = checkpointed(first)
    crowded = first.groupBy("anchor").agg(F.count(F.lit(1)).alias("classes")).filter("classes > 1")
    crowded = checkpointed(crowded)
    several = first.join(crowded.hint("merge"), "anchor").select("anchor", "content", "windows", "first.doc", "first.version", "first.start", "classes")
    several = checkpointed(several)
    asked = several.groupBy("doc", "version").agg(F.collect_list(F.struct("start", "windows", "anchor", "content", "classes")).alias("asked"))
    content = (
        known.join(asked.hint("merge"), ["doc", "version"])
        .select("doc", "text", "asked")
        .mapInArrow(partial(_content_batches, text="text", size=size), "doc long, start int, windows int, anchor long, content long, words binary")
    )
    content = checkpointed(content.dropDuplicates(["content", "anchor"]))
    release(several)
    masks = _masks(content, crowded, size, hot)
    marked = first.join(masks, ["anchor", "content"], "left").select("anchor", "content", "first", F.coalesce("earlier", F.lit(0)).alias("earlier"))
    marked = checkpointed(marked)  # so that the join below meets two exchanges, which Spark splits where one class is hot
    release(first, content, crowded)
    spans = kept.join(marked.hint("merge"), ["anchor", "content"])
    whole = F.expr("shiftleft(1L, windows) - 1")
    earliest = (F.col("doc") == F.col("first.doc")) & (F.col("start") == F.col("first.start"))
    return spans.select("doc", "version", "start", "windows", F.when(earliest, F.col("earlier")).otherwise(whole).alias("removed")).filter("removed <> 0")


def _masks(content: DataFrame, crowded: DataFrame, size: int, hot: int) -> DataFrame:
    """(anchor, content, earlier): which windows of each class an earlier class of the same minimizer holds."""
    n = content.count()
    shards = max(8, -(-n // SHARD_CLASSES))
    sized = content.join(crowded.hint("merge"), "anchor")
    calm = sized.filter(F.col("classes") <= hot).drop("classes")
    dealt = calm.repartition(shards, F.xxhash64("anchor")).sortWithinPartitions("anchor", "doc", "start", "content")
    few = dealt.select("anchor", "content", "words").mapInArrow(partial(_shard_batches, size=size), "content long, anchor long, earlier long")
    # minimizers with too many classes for one group: each window is a class, its own anchor, and its earliest place decides
    windows = sized.filter(F.col("classes") > hot).mapInArrow(
        partial(_window_batches, size=size), "anchor long, content long, doc long, start int, bit int, window long, other long"
    )
    windows = checkpointed(windows)
    earliest = windows.groupBy("window", "other").agg(F.min(F.struct("doc", "start")).alias("first"))
    bits = windows.join(earliest, ["window", "other"]).filter(F.struct("doc", "start") != F.col("first"))
    many = bits.groupBy("anchor", "content").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("earlier"))
    return few.select("anchor", "content", "earlier").unionByName(many)


@tidy
def _window_batches(batches, size: int):
    """Each window of a class as a row: its words' two hashes and its own place."""
    for batch in batches:
        rows = [np.frombuffer(w, np.uint64) for w in batch.column("words").to_pylist()]
        if not rows:
            continue
        flat = np.concatenate(rows)
        first = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        one = gram_hashes(flat, size).view(np.int64)
        other = gram_hashes(mix(flat), size).view(np.int64)
        count = np.maximum(np.diff(first) - size + 1, 0)
        owner = np.repeat(np.arange(len(rows)), count)
        bit = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        at = first[owner] + bit
        take = lambda n: batch.column(n).take(pa.array(owner, pa.int64()))  # noqa: B023, E731
        start = take("start").to_numpy() + bit
        arrays = [take("anchor"), take("content"), take("doc"), pa.array(start.astype(np.int32)), pa.array(bit.astype(np.int32)), pa.array(one[at]), pa.array(other[at])]
        yield pa.RecordBatch.from_arrays(arrays, ["anchor", "content", "doc", "start", "bit", "window", "other"])


def _removed(marks: np.ndarray, spans: list[dict], size: int) -> None:
    for span in spans:
        mask, start = span["removed"], span["start"]
        while mask:
            low = (mask & -mask).bit_length() - 1
            run = ((mask >> low) + 1 & ~(mask >> low)).bit_length() - 1
            marks[start + low : start + low + run + size - 1] = True
            mask &= ~((1 << run) - 1 << low)


@tidy
def _keep_batches(batches, text: str, size: int):
    for batch in batches:
        for part, texts in slices(batch, text):
            data, at = view(texts)
            starts, ends, first = word_spans(data, at)
            kept, words, removed = [], np.diff(first), []
            raw = data.tobytes()
            for row, spans in enumerate(part.column("spans").to_pylist()):
                a, b = first[row], first[row + 1]
                marks = np.zeros(b - a, bool)
                _removed(marks, spans or [], size)
                removed.append(int(marks.sum()))
                if not spans:
                    kept.append(b" ".join(raw[at[row] : at[row + 1]].split()))
                else:
                    keep = np.flatnonzero(~marks) + a
                    kept.append(b" ".join([raw[s:e] for s, e in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)]))
            names = [n for n in part.schema.names if n not in ("spans", text)]
            arrays = [part.column(n) for n in names]
            new = [pa.array(words.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*arrays, *new], [*names, "n_words", "n_removed", "kept"])


@tidy
def _cut_batches(batches, text: str, size: int, count: str | None, mark: str):
    """The rows with the removed words cut from their texts, with the white space after them; texts that lose all words go."""
    for batch in batches:
        for part, texts in slices(batch, text):
            data, at = view(texts)
            starts, ends, first = word_spans(data, at)
            raw, out, stay = data.tobytes(), [], []
            for row, spans in enumerate(part.column(mark).to_pylist()):
                if not spans:
                    out.append(None)
                    stay.append(True)
                    continue
                a, b = first[row], first[row + 1]
                marks = np.zeros(b - a, bool)
                _removed(marks, spans, size)
                edges = np.flatnonzero(np.diff(np.concatenate([[False], marks, [False]]).astype(np.int8)))
                pieces, before = [], at[row]
                for low, high in edges.reshape(-1, 2) + a:
                    pieces.append(raw[before : starts[low]])
                    before = starts[high] if high < b else ends[high - 1]
                pieces.append(raw[before : at[row + 1]])
                out.append(b"".join(pieces).decode())
                stay.append(not marks.all())
            changed = pa.array([x is not None for x in out])
            new = pa.array(out, pa.string())
            columns = []
            for name in part.schema.names:
                if name == text:
                    columns.append(pc.if_else(changed, new, part.column(name).cast(pa.string())))
                elif name == count:
                    columns.append(pc.if_else(changed, pc.utf8_length(new).cast(pa.int64()), part.column(name).cast(pa.int64())))
                elif name != mark:
                    columns.append(part.column(name))
            names = [n for n in part.schema.names if n != mark]
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(stay))


def _with_spans(docs: DataFrame, spans: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """The documents with their array of spans as column `name`; both sides are shuffled by key and text's hash, however small one is."""
    doc, version = unused("doc", docs.columns), unused("version", docs.columns)
    renamed = spans.select(F.col("doc").alias(doc), F.col("version").alias(version), F.col("spans").alias(name))
    same = (F.col(key).cast("long") == F.col(doc)) & (F.xxhash64(F.col(text)) == F.col(version))
    return docs.join(renamed.hint("merge"), same, "left").drop(doc, version)


def _spans_of_texts(docs: DataFrame, key: str, text: str, size: int, hot: int) -> DataFrame:
    """(doc, version, spans) of the texts that lose something, written."""
    with spent_tables() as made:
        spans = removal_spans(docs, key, text, size, hot)
        return kept_only(made, spans.groupBy("doc", "version").agg(F.collect_list(F.struct("start", "removed")).alias("spans")))


def cut_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", count: str | None = None, size: int = SIZE, hot: int = HOT) -> DataFrame:
    """The same columns, with repeated windows cut from the texts; `count` names a column with the number of characters, kept true.

    What stands between kept words stays as it is. Documents that lose all their words go; all others
    stay, with or without words, with all their other columns, whatever their names. Else as
    `drop_repeats`.
    """
    bounded_batches(docs.sparkSession)
    mark = unused("spans", docs.columns)
    joined = _with_spans(docs, _spans_of_texts(docs, key, text, size, hot), key, text, mark)
    typed = [F.col(f"`{c}`").cast("long").alias(c) if c == count else F.col(f"`{c}`") for c in joined.columns]
    schema = ", ".join(f"`{f.name}` {'bigint' if f.name == count else f.dataType.simpleString()}" for f in docs.schema)
    return joined.select(*typed).mapInArrow(partial(_cut_batches, text=text, size=size, count=count, mark=mark), schema)


def drop_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, hot: int = HOT) -> DataFrame:
    """Key, n_words, n_removed and `kept`: each text's words without those that a repeated window covers, one space between.

    Words are runs without bytes 9-13 and 32, unchanged. A null or empty text has none; a text with
    fewer than `size` words keeps all. A place is a key and a word's number, and the smaller place
    keeps its words: repeated rows have equal places and keep theirs alike; rows with one key and
    different texts count as one document, each keeps or loses the words of its own text. Rows with a
    null key are kept whole and take no part. Columns other than key and text are left out, whatever
    their names.
    """
    kept = docs.select(F.col(key).alias("doc_key"), F.col(text).alias("text"))
    joined = _with_spans(kept, _spans_of_texts(docs, key, text, size, hot), "doc_key", "text", "spans").select("doc_key", "text", "spans")
    kind = docs.schema[key].dataType.simpleString()
    out = joined.mapInArrow(partial(_keep_batches, text="text", size=size), f"doc_key {kind}, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("doc_key", key)
