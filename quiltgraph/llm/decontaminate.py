"""Benchmark decontamination with an FM-index per training shard.

A task packs its documents into shards of bounded size. Words that occur in
no phrase, and word pairs that follow one another in no phrase, end a run;
runs shorter than the shortest phrase can't hold one. What is left is indexed
word by word: suffix ranks by doubling, the Burrows-Wheeler transform in a
wavelet tree with rank counts on each level, and suffix positions sampled at
every eighth word and every start of a run. All phrases go through backward
search together; their occurrences are located by stepping back to the next
sampled position, and overlapping occurrences are merged into spans.

The phrases are a stated query set. They are collected in blocks of bounded
size; each block is broadcast by itself, so a benchmark of any size works,
with a pass over the documents for each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiltgraph.llm.common import checkpointed

WINDOW = 13
SAMPLE = 8
SHARD_WORDS = 2_000_000
BLOCK_PHRASES = 100_000
#: Bytes other than 0-9, A-Z, a-z and those of characters beyond ASCII part words.
_PARTED = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256))
#: The same words in Java syntax, before letters are made lower case.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLLOW_BITS = 22


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_PARTED).lower().split() if text else []


class WaveletTree:
    """Access and rank over integers; the levels of the tree lie in one array each."""

    def __init__(self, symbols: np.ndarray, n_symbols: int) -> None:
        self.bits = max(1, int(n_symbols - 1).bit_length())
        self.zeros, self.splits = [], []
        for level in range(self.bits - 1, -1, -1):
            ones = (symbols >> level & 1).astype(bool)
            self.zeros.append(np.r_[0, np.cumsum(~ones, dtype=np.int32)])
            self.splits.append(int(self.zeros[-1][-1]))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the first ``at`` symbols end on the lowest level, seen from each symbol."""
        for k, (zeros, split) in enumerate(zip(self.zeros, self.splits, strict=True)):
            before = zeros[at]
            at = np.where(symbols >> (self.bits - 1 - k) & 1, split + at - before, before)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs among the first ``at``."""
        return self.down(symbols, at) - self.down(symbols, np.zeros_like(at))

    def access(self, at: np.ndarray) -> np.ndarray:
        symbols = np.zeros(len(at), dtype=np.int64)
        for zeros, split in zip(self.zeros, self.splits, strict=True):
            before = zeros[at]
            one = zeros[at + 1] == before
            at = np.where(one, split + at - before, before)
            symbols = symbols << 1 | one
        return symbols


class FMIndex:
    """Over runs of symbols from 1 up; phrases lie within one run."""

    def __init__(self, symbols: np.ndarray, starts: np.ndarray, n_symbols: int) -> None:
        """``starts``: where each run starts. A symbol 0 is put before each run."""
        n_runs = len(starts)
        text = np.insert(symbols.astype(np.int64), starts, 0)
        n = len(text)
        ends = text == 0
        # the ends of runs differ, so comparison never goes on into another run
        rank = np.where(ends, np.cumsum(ends) - 1, text + n_runs - 1)
        step, width = 1, n_runs + n_symbols + 1
        while True:
            behind = np.zeros(n, dtype=np.int64)
            behind[:-step] = rank[step:] + 1
            key = rank * width + behind
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.r_[0, np.cumsum(ordered[1:] != ordered[:-1])]
            step, width = 2 * step, n + 1
            if rank[order[-1]] == n - 1 or step >= n:
                break
        self.n = n
        self.tree = WaveletTree(text[order - 1], n_symbols)
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=n_symbols))]
        kept = (np.arange(n) % SAMPLE == 0) | ends | np.r_[True, ends[:-1]]
        self.sampled = kept[order]
        self.slot = np.cumsum(self.sampled) - 1
        self.positions = order[self.sampled]
        self.run_of = np.cumsum(ends) - 1

    def search(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of phrases; row i holds its symbols from the last to the first."""
        low, high = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.n, dtype=np.int64)
        for step in range(phrases.shape[1]):
            live = np.flatnonzero((step < sizes) & (low < high))
            if not len(live):
                break
            symbols = phrases[live, step]
            low[live] = self.before[symbols] + self.tree.rank(symbols, low[live])
            high[live] = self.before[symbols] + self.tree.rank(symbols, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the symbols given, for rows of the suffix order."""
        steps, found = np.zeros(len(rows), dtype=np.int64), np.empty(len(rows), dtype=np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            done = self.sampled[rows[open_]]
            hit = open_[done]
            found[hit] = self.positions[self.slot[rows[hit]]] + steps[hit]
            open_ = open_[~done]
            symbols = self.tree.access(rows[open_])
            rows[open_] = self.before[symbols] + self.tree.rank(symbols, rows[open_])
            steps[open_] += 1
        return found - self.run_of[found] - 1


class Phrases(NamedTuple):
    """What a task needs to look for: all sizes are bounded by the block."""

    symbols: dict[bytes, int]
    rows: np.ndarray
    sizes: np.ndarray
    items: list[list[str]]
    follow: np.ndarray


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * 2_654_435_761 + b) & ((1 << _FOLLOW_BITS) - 1)


def compiled(windows: dict[tuple[bytes, ...], set[str]]) -> Phrases:
    """Phrases as rows of symbols, and which symbols may follow one another."""
    symbols: dict[bytes, int] = {}
    width = max(map(len, windows), default=1)
    rows = np.zeros((len(windows), width), dtype=np.int64)
    sizes = np.fromiter(map(len, windows), np.int64, len(windows))
    follow = np.zeros(1 << _FOLLOW_BITS, dtype=bool)
    for i, window in enumerate(windows):
        ids = np.array([symbols.setdefault(w, len(symbols) + 1) for w in window], dtype=np.int64)
        rows[i, : len(ids)] = ids[::-1]
        follow[_pair(ids[:-1], ids[1:])] = True
    return Phrases(symbols, rows, sizes, [sorted(x) for x in windows.values()], follow)


def blocks(items: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[dict[tuple[bytes, ...], set[str]]]:
    """The windows of all items with their ids, in blocks of ``BLOCK_PHRASES`` or a little more."""
    found: dict[tuple[bytes, ...], set[str]] = {}
    for row in items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("binary").alias("t")).toLocalIterator():
        words = words_of(bytes(row.t) if row.t is not None else None)
        for k in range(max(min(len(words), 1), len(words) - window + 1)):
            found.setdefault(tuple(words[k : k + window]), set()).add(row.i or "")
        if len(found) >= BLOCK_PHRASES:
            yield found
            found = {}
    yield found


def _searched(ids: np.ndarray, offsets: np.ndarray, phrases: Phrases) -> list[tuple[list[int], list[str]]]:
    """For each document of a shard: starts and ends of its merged spans in turn, and the items found."""
    n_docs, n = len(offsets) - 1, len(ids)
    least = int(phrases.sizes.min()) if len(phrases.sizes) else n + 1
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    known = ids > 0
    joined = np.zeros(n + 1, dtype=bool)
    if n > 1:
        joined[1:n] = known[1:] & known[:-1] & ~first[1:n] & phrases.follow[_pair(ids[:-1], ids[1:])]
    heads = np.flatnonzero(known & ~joined[:n])
    tails = np.flatnonzero(known & ~joined[1:]) + 1
    wide = tails - heads >= least
    heads, tails = heads[wide], tails[wide]
    empty: tuple[list[int], list[str]] = ([], [])
    if not len(heads):
        return [empty] * n_docs
    sizes = tails - heads
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    at = np.arange(int(sizes.sum())) + np.repeat(heads - starts, sizes)
    index = FMIndex(ids[at], starts, len(phrases.symbols) + 1)
    low, high = index.search(phrases.rows, phrases.sizes)
    hits = np.flatnonzero(high > low)
    counts = (high - low)[hits]
    window = np.repeat(hits, counts)
    shift = np.r_[0, np.cumsum(counts)[:-1]] if len(counts) else counts
    where = at[index.locate(np.arange(int(counts.sum())) + np.repeat(low[hits] - shift, counts))]
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, where, 1)
    np.add.at(edge, where + phrases.sizes[window], -1)
    covered = np.r_[False, np.cumsum(edge[:n]) > 0, False]
    step = np.flatnonzero(covered[1:] != covered[:-1])
    opened, closed = step[::2], step[1::2]
    # a span that goes on into the next document is two spans
    inner = np.unique(offsets[1:-1][covered[offsets[1:-1]] & covered[offsets[1:-1] + 1]])
    opened, closed = np.sort(np.r_[opened, inner]), np.sort(np.r_[closed, inner])
    doc_of_span = np.searchsorted(offsets, opened, side="right") - 1
    n_windows = len(phrases.sizes)
    pairs = np.unique((np.searchsorted(offsets, where, side="right") - 1) * n_windows + window)
    out = [empty] * n_docs
    for doc, a, b in zip(doc_of_span.tolist(), opened.tolist(), closed.tolist(), strict=True):
        if out[doc] is empty:
            out[doc] = ([], [])
        out[doc][0].extend((a - int(offsets[doc]), b - int(offsets[doc])))
    items: dict[int, set[str]] = {}
    for doc, w in zip((pairs // n_windows).tolist(), (pairs % n_windows).tolist(), strict=True):
        items.setdefault(doc, set()).update(phrases.items[w])
    for doc, found in items.items():
        out[doc][1].extend(sorted(found))
    return out


def _scanned(docs: DataFrame, shared: Broadcast[Phrases]) -> DataFrame:
    """``docs``: ``(doc_id, text, row)``; the row id is handed on."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looked = shared.value
        symbol = looked.symbols.get

        def shard(keys: list, rows: list[int], ids: list[np.ndarray]) -> pa.RecordBatch:
            offsets = np.r_[0, np.cumsum([len(x) for x in ids], dtype=np.int64)]
            found = _searched(np.concatenate(ids), offsets, looked)
            columns = [pa.array(keys, pa.int64()), pa.array(rows, pa.int64()), pa.array(np.diff(offsets)), pa.array([x for x, _ in found], pa.list_(pa.int64())), pa.array([x for _, x in found], pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "n_words", "bounds", "items"])

        keys, rows, ids, size = [], [], [], 0
        for batch in batches:
            for key, text, row in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), strict=True):
                words = words_of(text.as_py())
                keys.append(key)
                rows.append(row)
                ids.append(np.fromiter(map(symbol, words, repeat(0)), np.int64, len(words)))
                size += len(words)
                if size >= SHARD_WORDS or len(keys) >= 20_000:
                    yield shard(keys, rows, ids)
                    keys, rows, ids, size = [], [], [], 0
        if keys:
            yield shard(keys, rows, ids)

    return docs.mapInArrow(scan, "doc_id long, row long, n_words long, bounds array<long>, items array<string>")


def _spans(bounds: Column) -> Column:
    pairs = F.sequence(F.lit(0), F.floor(F.size(bounds) / 2).cast("int") - 1)
    spans = F.transform(pairs, lambda i: F.struct(bounds[2 * i].alias("start"), bounds[2 * i + 1].alias("end")))
    return F.when(F.size(bounds) > 0, spans).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))


def occurrences(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``(doc_id, n_words, spans, items)``, a row for each row of ``docs``.

    ``spans``: merged word spans ``start`` to ``end`` (exclusive) covered by a
    window of any item; ``items``: the ids of those items as sorted strings.
    Null and empty texts have no words, an item without words no window, and
    an item of fewer than ``window`` words is one window. Repeated items
    and rows count as they stand, an item's null id as an empty string. Further
    columns are ignored. With more items than fit a block, a pass is made for
    each block in turn, the driver holding one block at a time, and the passes
    are merged by an id given to each row.
    """
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = blocks(items, item_col, item_text, window)
    first, second = next(found), next(found, None)
    broadcast = docs.sparkSession.sparkContext.broadcast
    if second is None:
        return _scanned(kept.withColumn("row", F.lit(0).cast("long")), broadcast(compiled(first))).select("doc_id", "n_words", _spans(F.col("bounds")).alias("spans"), "items")
    kept = checkpointed(kept.withColumn("row", F.monotonically_increasing_id()))
    every = None
    for block in chain((first, second), found):
        shared = broadcast(compiled(block))
        one = _scanned(kept, shared)
        one = checkpointed(one if every is None else one.where("size(bounds) > 0"))
        shared.unpersist()
        every = one if every is None else every.unionByName(one)
    merged = every.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list(_spans(F.col("bounds"))))).alias("raw"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return merged.select("doc_id", "n_words", _merged(F.col("raw")).alias("spans"), "items")


def _merged(spans: Column) -> Column:
    """Sorted spans, those that overlap or touch made one."""

    def add(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        grown = F.struct(last.start.alias("start"), F.greatest(last.end, span.end).alias("end"))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)).end >= span.start), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(spans, F.array().cast("array<struct<start:bigint,end:bigint>>"), add)


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """A twentieth of the words or more are hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def n_hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])


def cut(text: Column, spans: Column) -> Column:
    """``text`` without the words of ``spans`` and what stands between them."""
    whole = f"(?s)(.*?)({WORD}|\\z)"
    gaps, found = F.regexp_extract_all(text, F.lit(whole), F.lit(1)), F.regexp_extract_all(text, F.lit(whole), F.lit(2))

    def kept(gap: Column, word: Column, k: Column) -> Column:
        inside = F.exists(spans, lambda s: (s["start"] < k) & (k < s["end"]))
        first = F.exists(spans, lambda s: s["start"] == k)
        return F.when(inside, F.lit("")).when(first, gap).otherwise(F.concat(gap, word))

    parts = F.zip_with(gaps, found, lambda g, w: F.struct(g.alias("gap"), w.alias("word")))
    return F.array_join(F.transform(parts, lambda p, k: kept(p["gap"], p["word"], k)), "")
