"""Substring dedup with suffix automata of reference shards.

Every window of 20 words has a key: the smallest hash among its runs of
``GRAM`` words. Equal windows have equal keys, so a window can only repeat
where its key does. Keys are counted first; only stretches of text whose keys
repeat go further, each to the shard of its key. Equal stretches are merged on
the way with the first place kept, so a shard holds different texts only. A
shard's suffix automaton is built over its stretches, with the first place of
each state, and the stretches are streamed through it: their matching
statistics tell for each window where its words start first. All other
windows with repeated keys are removed, merged to maximal spans.

Shards hold ``SHARD_WORDS`` words or one key. A key found in more than
``HOT_KEY`` documents, such as one within a line on very many pages, is split:
its windows go by themselves, keyed by the hash of the whole window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltgraph.llm.common import checkpointed, gram_hashes

WINDOW = 20
GRAM = 8
HOT_KEY = 10_000
SHARD_WORDS = 100_000
FLUSH_KEYS = 1_000_000
#: What tells documents apart and orders them: whether there is an id, and the id or the text's hash.
OWNER = ("known", "doc_id")


def words_of(text: bytes | None) -> list[bytes]:
    return text.split() if text else []


def window_keys(words: list[bytes], window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """For each window of words the smallest hash of its runs of ``gram`` words."""
    return _least(gram_hashes(words, gram), window, gram).view(np.int64) if len(words) >= window else np.empty(0, dtype=np.int64)


def key_places(words: list[bytes], window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """The keys of a text's windows, once for each place of the text at which a window has its key.

    A text that repeats itself within 20 words has two places of one key close together.
    """
    if len(words) < window:
        return np.empty(0, dtype=np.int64)
    grams = gram_hashes(words, gram)
    least = _least(grams, window, gram)
    place = np.zeros(len(grams), dtype=bool)
    for k in range(window - gram + 1):
        place[k : k + len(least)] |= grams[k : k + len(least)] == least
    return grams[place].view(np.int64)


def _least(grams: np.ndarray, window: int, gram: int) -> np.ndarray:
    wide, least = 1, grams
    while 2 * wide <= window - gram + 1:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    rest = window - gram + 1 - wide
    return np.minimum(least[:-rest], least[rest:]) if rest else least


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of windows with one key."""
    edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return np.r_[0, edges][: len(keys)], np.r_[edges, len(keys)] if len(keys) else edges


class SuffixAutomaton:
    """Of several texts. Each state knows the least place at which its strings end."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.size, self.first = [-1], [0], [1 << 100]
        self.last = 0

    def start(self) -> None:
        """From here on another text follows."""
        self.last = 0

    def add(self, word: bytes, place: int) -> None:
        to, link, size, first = self.next, self.link, self.size, self.first
        p = self.last
        q = to[p].get(word)
        if q is not None and size[q] == size[p] + 1:  # the text so far is known
            if place < first[q]:
                first[q] = place
            self.last = q
            return
        if q is None:
            new = len(to)
            to.append({})
            size.append(size[p] + 1)
            first.append(place)
            link.append(0)
            while p >= 0 and word not in to[p]:
                to[p][word] = new
                p = link[p]
            self.last = new
            if p < 0:
                return
            q = to[p][word]
            if size[q] == size[p] + 1:
                link[new] = q
                return
        else:
            new = -1
        clone = len(to)
        to.append(to[q].copy())
        size.append(size[p] + 1)
        first.append(place if new < 0 else 1 << 100)
        link.append(link[q])
        while p >= 0 and to[p].get(word) == q:
            to[p][word] = clone
            p = link[p]
        link[q] = clone
        if new < 0:
            self.last = clone
        else:
            link[new] = clone

    def spread(self) -> None:
        """Hands each state the least place of all states whose strings end with its own."""
        link, first = self.link, self.first
        for state in np.argsort(np.array(self.size), kind="stable")[:0:-1].tolist():
            up = link[state]
            if first[state] < first[up]:
                first[up] = first[state]

    def firsts(self, words: list[bytes], window: int) -> list[int]:
        """Matching statistics: for each window of a text the least place at which its words end."""
        to, link, size, first = self.next, self.link, self.size, self.first
        state, length, out = 0, 0, []
        for word in words:
            while state and word not in to[state]:
                state = link[state]
                length = size[state]
            state = to[state].get(word, 0)
            length = length + 1 if state else 0
            if length >= window:
                while size[link[state]] >= window:
                    state = link[state]
                length = window
                out.append(first[state])
            else:
                out.append(-1)
        return out[window - 1 :]


def mark(words: list[bytes], at: int, start: int, window: int = WINDOW) -> int:
    """A number for the window at ``at``, hashed from its words and its place ``start`` in the document."""
    return xxhash.xxh64_intdigest(b" ".join(words[at : at + window]), start) - (1 << 63)


def first_windows(stretches: list[tuple[tuple[bool, int], int, bytes]], window: int = WINDOW) -> list[tuple[tuple[bool, int], list[int]]]:
    """For each stretch ``(document, start, text)`` of a shard: the marks of its windows found nowhere earlier."""
    rank = {d: i for i, d in enumerate(sorted({s[0] for s in stretches}))}
    automaton, cut = SuffixAutomaton(), []
    for doc, start, text in stretches:
        words = text.split()
        place = (rank[doc] << 40) + start
        automaton.start()
        for word in words:
            automaton.add(word, place)
            place += 1
        cut.append(words)
    automaton.spread()
    out = []
    for (doc, start, _), words in zip(stretches, cut, strict=True):
        end = (rank[doc] << 40) + start + window - 1
        out.append((doc, [mark(words, j, start + j, window) for j, found in enumerate(automaton.firsts(words, window)) if found == end + j]))
    return out


def _keyed(docs: DataFrame, with_docs: bool) -> DataFrame:
    """``(key, n)``, or ``(key, known, doc_id)``: how many places have a key, or which documents."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, owners, size = [], [], 0

        def flushed() -> pa.RecordBatch:
            keys = np.concatenate(held)
            if with_docs:
                known, ids = (np.repeat(np.array([o[c] for o in owners]), [o[2] for o in owners]) for c in (0, 1))
                return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(known), pa.array(ids, pa.int64())], ["key", "known", "doc_id"])
            keys, n = np.unique(keys, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])

        for batch in batches:
            for known, doc, text in zip(*(batch.column(c).to_pylist() for c in (0, 1)), batch.column(2), strict=True):
                words = words_of(text.as_py())
                keys = np.unique(window_keys(words)) if with_docs else key_places(words)
                if not len(keys):
                    continue
                held.append(keys)
                owners.append((known, doc, len(keys)))
                size += len(keys)
                if size >= FLUSH_KEYS:
                    yield flushed()
                    held, owners, size = [], [], 0
        if held:
            yield flushed()

    return docs.mapInArrow(scan, "key long, known boolean, doc_id long" if with_docs else "key long, n long")


def repeated_keys(docs: DataFrame) -> DataFrame:
    """``(known, doc_id, keys, hot_keys)``: for each document its keys that repeat anywhere."""
    counts = _keyed(docs, False).groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > 1)
    owned = _keyed(docs, True).join(counts, "key")
    hot = F.col("n") > HOT_KEY
    return owned.groupBy(*OWNER).agg(F.collect_set(F.when(~hot, F.col("key"))).alias("keys"), F.collect_set(F.when(hot, F.col("key"))).alias("hot_keys"))


def _repeating(keys: np.ndarray, repeated: list[int] | None) -> np.ndarray:
    return np.isin(keys, np.array(repeated, dtype=np.int64)) if repeated else np.zeros(len(keys), dtype=bool)


def _stretches(joined: DataFrame) -> DataFrame:
    """``(key, known, doc_id, start, text)`` of what may repeat."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                keys_out, known_out, docs_out, starts_out, texts_out = [], [], [], [], []
                for row in batch.slice(at, 500).to_pylist():
                    words = words_of(row["text"])
                    keys = window_keys(words)
                    begins, ends = runs(keys)
                    for hot, repeated in ((False, row["keys"]), (True, row["hot_keys"])):
                        chosen = _repeating(keys[begins], repeated)
                        for a, b in zip(begins[chosen].tolist(), ends[chosen].tolist(), strict=True):
                            spans = [(i, i + 1) for i in range(a, b)] if hot else [(a, b)]
                            for i, j in spans:
                                text = b" ".join(words[i : j + WINDOW - 1])
                                keys_out.append(xxhash.xxh64_intdigest(text, 1) - (1 << 63) if hot else int(keys[a]))
                                known_out.append(row["known"])
                                docs_out.append(row["doc_id"])
                                starts_out.append(i)
                                texts_out.append(text)
                if keys_out:
                    columns = [pa.array(keys_out, pa.int64()), pa.array(known_out, pa.bool_()), pa.array(docs_out, pa.int64()), pa.array(starts_out, pa.int64()), pa.array(texts_out, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "known", "doc_id", "start", "text"])

    return joined.mapInArrow(scan, "key long, known boolean, doc_id long, start long, text binary")


def _kept_windows(stretches: DataFrame) -> DataFrame:
    """``(known, doc_id, marks)``: windows found nowhere earlier, by way of the shards' automata."""
    merged = stretches.groupBy("key", "text").agg(F.min(F.struct(*OWNER, "start")).alias("at")).select("key", "at.known", "at.doc_id", "at.start", "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, size, last = [], 0, None

        def found() -> pa.RecordBatch:
            kept = [x for x in first_windows(shard) if x[1]]
            columns = [pa.array([d[0] for d, _ in kept], pa.bool_()), pa.array([d[1] for d, _ in kept], pa.int64()), pa.array([m for _, m in kept], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, [*OWNER, "marks"])

        for batch in batches:
            for key, known, doc, start, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != last and size >= SHARD_WORDS:
                    yield found()
                    shard, size = [], 0
                last = key
                shard.append(((known, doc), start, text))
                size += 1 + text.count(b" ")
        if shard:
            yield found()

    return merged.repartition("key").sortWithinPartitions("key").mapInArrow(scan, "known boolean, doc_id long, marks array<long>")


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, spans, kept)``, a row for each row of ``docs``.

    A window of 20 words is removed where the same words start earlier, in a
    document of smaller id or earlier in the same one; windows are judged on
    the input. ``spans``: maximal spans ``start`` to ``end`` of words covered
    by such windows; ``kept``: the other words, one space between them. Null
    and empty texts have no words, texts of fewer than 20 no window. Rows of
    one doc_id are one document, whose windows start where they start in their
    row: repeated rows remove nothing from one another, and of rows that
    differ each keeps what starts first. Rows without an id come before all
    others; those of one text are one document, and different ones are ordered
    by the texts' hashes, so that no number of them meets under one key.
    Further columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    owned = docs.select(F.col("id").isNotNull().alias("known"), F.coalesce("id", F.xxhash64("text")).alias("doc_id"), "text")
    keys = checkpointed(repeated_keys(owned))
    joined = owned.join(keys, [*OWNER], "left")
    kept = _kept_windows(_stretches(joined.where(F.col("keys").isNotNull()))).groupBy(*OWNER).agg(F.flatten(F.collect_list("marks")).alias("marks"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                out = []
                for row in batch.slice(at, 500).to_pylist():
                    words = words_of(row["text"])
                    spans, rest = [], words
                    if row["keys"] or row["hot_keys"]:
                        keys = window_keys(words)
                        gone = _repeating(keys, [*row["keys"], *row["hot_keys"]])
                        if row["marks"]:
                            kept = set(row["marks"])
                            gone[[i for i in np.flatnonzero(gone).tolist() if mark(words, i, i) in kept]] = False
                        edge = np.zeros(len(words) + 1, dtype=np.int64)
                        hit = np.flatnonzero(gone)
                        edge[hit] += 1
                        edge[hit + WINDOW] -= 1
                        covered = np.r_[False, np.cumsum(edge[:-1]) > 0, False]
                        steps = np.flatnonzero(covered[1:] != covered[:-1]).tolist()
                        spans = [{"start": a, "end": b} for a, b in zip(steps[::2], steps[1::2], strict=True)]
                        rest = [w for w, c in zip(words, covered[1:].tolist(), strict=False) if not c]
                    out.append((row["doc_id"] if row["known"] else None, len(words), spans, b" ".join(rest).decode()))
                types = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["doc_id", "n_words", "spans", "kept"])

    every = owned.join(keys, [*OWNER], "left").join(kept, [*OWNER], "left")
    return every.mapInArrow(scan, "doc_id long, n_words long, spans array<struct<start:long,end:long>>, kept string")
