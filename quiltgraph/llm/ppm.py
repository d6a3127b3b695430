"""LM scoring by prediction by partial matching.

A trie of byte contexts up to three bytes long is counted over the training
documents. A byte's chance is its share in the longest context that has
followed by it; each longer context charges its escape, estimated by the
number of different bytes seen there, and the bytes it has seen are excluded
from the shorter ones. Below the empty context all bytes left are alike.
A text's score is the sum of the logarithms, the negative of its code length.

Counts cover every training document and are summed before they are shuffled,
and every context counted is used. Strings of up to three bytes, at most
``2**24 + 2**16 + 2**8`` of them, are broadcast to the tasks that compute the
chance of each string of one to four bytes in any document. The ``MAX_GRAMS``
most frequent strings are broadcast with their chances for scoring; each other
string of a document meets its chance in a join.

The base score needs the exact count of every token. Tokens that make up
``1 / MAX_FREQUENT`` of all or more, at most ``MAX_FREQUENT`` of them, are
broadcast; each other token of a document meets its count in a join.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from math import log10
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltgraph.llm.common import checkpointed

ORDER = 3
MAX_GRAMS = 1 << 21
MAX_FREQUENT = 1 << 17
CHUNK = 2_000_000
KEPT_TOKENS = 200_000
TOKEN, GRAM, HELD = 0, 1, 2
_SIZE = 40
_BYTES = (1 << _SIZE) - 1
PAD = 256
END = b""


def held_out(doc_id: int | None) -> bool:
    """A tenth of the documents; one without an id is learned from."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def tokens_of(text: bytes) -> list[bytes]:
    """Words in lower case, then the end, which no word equals."""
    return [*text.lower().split(), END]


def _padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes with ``ORDER`` pads before each text, and where each text starts."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes + ORDER) - sizes
    symbols = np.full(int((sizes + ORDER).sum()), PAD, dtype=np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    symbols[np.arange(len(data)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)] = data
    return symbols, starts


def gram_counts(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Strings of up to ``order + 1`` bytes with their counts; a string is packed as ``size << 40 | bytes``.

    Longer strings are numbered by way of those one shorter that were seen.
    """
    symbols, _ = _padded(texts)
    used = np.flatnonzero(np.bincount(symbols, minlength=PAD + 1)[:PAD])
    if not len(used):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    m = len(used)
    place = np.full(PAD + 1, -1, dtype=np.int64)
    place[used] = np.arange(m)
    at = place[symbols]
    ids, packed, codes, counts = np.zeros(len(at) + 1, np.int64), np.zeros(1, np.int64), [], []
    for size in range(1, order + 2):
        before = ids[:-1] if size > 1 else np.zeros(len(at), np.int64)
        code = np.where((at >= 0) & (before >= 0), before * m + at, -1)
        live = code[code >= 0]
        span = len(packed) * m
        if span <= 1 << 23:
            count = np.bincount(live, minlength=span)
            seen = np.flatnonzero(count)
            count = count[seen]
            number = np.full(span + 1, -1, dtype=np.int64)
            number[seen] = np.arange(len(seen))
            fresh = number[code]
        else:
            seen, count = np.unique(live, return_counts=True)
            fresh = np.where(code >= 0, np.searchsorted(seen, code), -1)
        packed = packed[seen // m] << 8 | used[seen % m]
        codes.append(size << 40 | packed)
        counts.append(count)
        ids = np.r_[-1, fresh]
        if not len(seen):
            break
    return np.concatenate(codes), np.concatenate(counts)


def _summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate(codes), return_inverse=True)
    return keys, np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)


def counted(docs: DataFrame) -> DataFrame:
    """``(kind, key, n)``: tokens and byte strings of the training documents, and byte strings of those held out; a string as eight bytes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(kind: int, keys: pa.Array, n: list[int] | np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), keys, pa.array(n, pa.int64())], ["kind", "key", "n"])

        tokens: Counter[bytes] = Counter()
        codes, counts, texts, size = {GRAM: [], HELD: []}, {GRAM: [], HELD: []}, {GRAM: [], HELD: []}, {GRAM: 0, HELD: 0}
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                data = text.as_py() or b""
                kind = HELD if held_out(key) else GRAM
                texts[kind].append(data)
                size[kind] += len(data)
                if size[kind] >= CHUNK:
                    found = gram_counts(texts[kind])
                    codes[kind].append(found[0])
                    counts[kind].append(found[1])
                    texts[kind], size[kind] = [], 0
                    if len(codes[kind]) == 8:
                        merged = _summed(codes[kind], counts[kind])
                        codes[kind], counts[kind] = [merged[0]], [merged[1]]
                if kind == HELD:
                    continue
                tokens.update(tokens_of(data))
                if len(tokens) >= KEPT_TOKENS:
                    yield rows(TOKEN, pa.array(list(tokens), pa.binary()), list(tokens.values()))
                    tokens = Counter()
        if tokens:
            yield rows(TOKEN, pa.array(list(tokens), pa.binary()), list(tokens.values()))
        for kind in (GRAM, HELD):
            found = gram_counts(texts[kind]) if texts[kind] else (np.empty(0, np.int64),) * 2
            keys, n = _summed([*codes[kind], found[0]], [*counts[kind], found[1]])
            if len(keys):
                fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8), len(keys), [None, pa.py_buffer(keys.astype(">i8").tobytes())])
                yield rows(kind, fixed.cast(pa.binary()), n)

    return docs.mapInArrow(scan, "kind int, key binary, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _context(codes: np.ndarray) -> np.ndarray:
    """Packed strings without their last byte."""
    return (codes >> _SIZE) - 1 << _SIZE | (codes & _BYTES) >> 8


def _shorter(codes: np.ndarray) -> np.ndarray:
    """Packed strings without their first byte; the empty one stays."""
    sizes = np.maximum((codes >> _SIZE) - 1, 0)
    return sizes << _SIZE | codes & (np.left_shift(1, 8 * sizes) - 1)


class Trie:
    """Contexts with the count of each byte after them."""

    def __init__(self, grams: dict[bytes, int] | tuple[np.ndarray, np.ndarray]) -> None:
        """``grams``: counts of every context and the byte after it, or the packed strings and their counts."""
        if isinstance(grams, dict):
            packed = (len(g) << _SIZE | int.from_bytes(g, "big") for g in grams)
            grams = np.fromiter(packed, np.int64, len(grams)), np.fromiter(grams.values(), np.int64, len(grams))
        codes, n = grams
        before = _context(codes)
        self.contexts = np.unique(np.r_[0, before])
        self.counts = np.zeros((len(self.contexts), 256), dtype=np.float32)
        self.counts[np.searchsorted(self.contexts, before), codes & 255] = n
        #: The context without its first byte; the empty one has none.
        self.shorter = np.r_[-1, self.longest(_shorter(self.contexts[1:]))]

    def longest(self, codes: np.ndarray) -> np.ndarray:
        """The longest end of each packed string that is a context."""
        out = np.full(len(codes), -1)
        while (out < 0).any():
            at = np.minimum(np.searchsorted(self.contexts, codes), len(self.contexts) - 1)
            out = np.where((out < 0) & (self.contexts[at] == codes), at, out)
            codes = _shorter(codes)
        return out

    def logs_after(self, counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """The log10 chance of each byte after contexts with these counts; ``shorter``: the next context, -1 for none."""
        chance, reach = np.zeros(counts.shape), np.ones((len(counts), 1))
        excluded = np.zeros(counts.shape, dtype=bool)
        at = shorter
        while True:
            here = np.where(excluded, 0, counts).astype(np.float64)
            total, kinds = here.sum(axis=1, keepdims=True), (here > 0).sum(axis=1, keepdims=True)
            some = total > 0
            whole = np.where(some, total + kinds, 1)
            chance += reach * here / whole
            reach = np.where(some, reach * kinds / whole, reach)
            excluded |= here > 0
            live = at >= 0
            if not live.any():
                break
            counts = np.where(live[:, None], self.counts[at], 0)
            at = np.where(live, self.shorter[at], -1)
        left = 256 - excluded.sum(axis=1, keepdims=True)
        chance += np.where(excluded, 0, reach / np.maximum(left, 1))
        return np.log10(chance)

    @property
    def logs(self) -> np.ndarray:
        return self.logs_after(self.counts, self.shorter)


def grams_of(texts: list[bytes]) -> np.ndarray:
    """For each byte of the texts, one after another, the packed string of it and up to ``ORDER`` bytes before it."""
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes) - sizes
    out = data.copy()
    for back in range(1, ORDER + 1):
        out[back:] |= data[:-back] << 8 * back
    out |= ORDER + 1 << _SIZE
    for i in range(ORDER):
        early = starts[sizes > i] + i
        out[early] = i + 1 << _SIZE | out[early] & (1 << 8 * (i + 1)) - 1
    return out


def gram_logs(counts: DataFrame) -> DataFrame:
    """``(code, m, log)`` of every byte string of any document: how often it occurs, and the log10 chance of its last byte after the others."""
    code = F.conv(F.hex("key"), 16, 10).cast("long")
    grams = counts.where(F.col("kind") != TOKEN).select(code.alias("code"), "kind", "n")
    short = grams.where((F.col("kind") == GRAM) & (F.col("code") < (ORDER + 1) << _SIZE)).select("code", "n").toArrow()
    shared = counts.sparkSession.sparkContext.broadcast(tuple(short.column(c).to_numpy() for c in ("code", "n")))
    name = uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _tries.get(name)
        if trie is None:
            _tries.clear()
            trie = _tries[name] = Trie(shared.value)
        for batch in batches:
            for start in range(0, len(batch), 2048):
                part = batch.column(0).slice(start, 2048).flatten()
                code, kind, n = (part.field(i).to_numpy() for i in range(3))
                contexts, row = np.unique(_context(code), return_inverse=True)
                own = np.zeros((len(contexts), 256))
                np.add.at(own, (row, code & 255), np.where(kind == GRAM, n, 0))
                shorter = np.where(contexts > 0, trie.longest(_shorter(contexts)), -1)
                logs = trie.logs_after(own, shorter)[row, code & 255]
                codes, first, same = np.unique(code, return_index=True, return_inverse=True)
                m = np.bincount(same, weights=n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(m), pa.array(logs[first])], ["code", "m", "log"])

    context = F.shiftright("code", 8).bitwiseAND((1 << _SIZE - 8) - 1)
    size = F.shiftright("code", _SIZE)
    grouped = grams.groupBy(size.alias("size"), context.alias("context")).agg(F.collect_list(F.struct("code", "kind", "n")).alias("grams"))
    return grouped.select("grams").mapInArrow(scan, "code long, m long, log double")


def least_bits(logs: DataFrame, most: int) -> int:
    """The bits that ``m`` must have at least, so that ``most`` strings at most have them.

    Each other string makes up less than ``2 / most`` of all.
    """
    bits = logs.groupBy(F.length(F.bin("m")).alias("bits")).count().collect()
    least, room = 65, most
    for b, n in sorted(bits, reverse=True):
        room -= n
        if room < 0:
            break
        least = b
    return least


def scored_by(codes: np.ndarray, logs: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The sum of the logs of each text's strings, and the strings not in ``codes``: text, string, and how often."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    out, none = np.zeros(len(texts)), np.empty(0, np.int64)
    if not sizes.sum():
        return out, (none, none, none)
    grams = grams_of(texts)
    at = np.searchsorted(codes, grams)
    at[at == len(codes)] = 0
    hit = codes[at] == grams if len(codes) else np.zeros(len(grams), dtype=bool)
    found = np.where(hit, logs[at], 0) if len(codes) else np.zeros(len(grams))
    full = np.flatnonzero(sizes)
    out[full] = np.add.reduceat(found, (np.cumsum(sizes) - sizes)[full])
    if hit.all():
        return out, (none, none, none)
    pairs, k = np.unique(np.repeat(np.arange(len(texts)), sizes)[~hit] << _SIZE + 3 | grams[~hit], return_counts=True)
    return out, (pairs >> _SIZE + 3, pairs & (1 << _SIZE + 3) - 1, k)


_tries: dict[str, Trie] = {}


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs`` with ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Learns from the documents that ``held_out`` leaves. Null counts as empty:
    one token, the end, and a score of 0. Repeated rows are counted and scored
    each. Without training documents N and V are 0 and all bytes alike.
    Further columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counts = checkpointed(counted(docs))
    tokens = counts.where(F.col("kind") == TOKEN).select(F.col("key").alias("token"), F.col("n").alias("c"))
    n, v = tokens.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    common = tokens.where((F.col("c") * MAX_FREQUENT >= n) | (F.col("token") == END)).toArrow()
    frequent = dict(zip(common.column("token").to_pylist(), common.column("c").to_pylist(), strict=True))
    rest = n + 0.1 * (v + 1)
    chances = checkpointed(gram_logs(counts))
    is_frequent = F.length(F.bin("m")) >= least_bits(chances, MAX_GRAMS)
    kept = chances.where(is_frequent).select("code", "log").toArrow()
    codes, logs = kept.column("code").to_numpy(), kept.column("log").to_numpy()
    order = np.argsort(codes)
    shared = docs.sparkSession.sparkContext.broadcast((frequent, codes[order], logs[order]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, codes, logs = shared.value
        row = TaskContext.get().partitionId() << 40
        types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        names = ["rid", "token", "k", "doc_id", "held_out", "n_tokens", "n_known", "base", "score"]
        chance = {t: log10((c + 0.1) / rest) for t, c in known.items()}

        def flushed(keys: list, texts: list[bytes]) -> pa.RecordBatch:
            nonlocal row
            mains, rares = [], ([], [], [])
            scores, (doc, gram, k) = scored_by(codes, logs, texts)
            rares[0].extend((doc + row).tolist())
            rares[1].extend(b"\t" + g.to_bytes(8, "big") for g in gram.tolist())
            rares[2].extend(k.tolist())
            for key, text, score in zip(keys, texts, scores.tolist(), strict=True):
                words = tokens_of(text)
                found = [*map(chance.get, words)]
                base = sum(filter(None, found))
                n_known = len(found) - found.count(None)
                if n_known < len(found):
                    for token, k in Counter(t for t, x in zip(words, found, strict=True) if x is None).items():
                        rares[0].append(row)
                        rares[1].append(token)
                        rares[2].append(k)
                mains.append((row, b" %d" % row, 1, key, held_out(key), len(words), n_known, base, score))
                row += 1
            columns = [list(x) for x in zip(*mains, strict=True)]
            more = [*rares, *[[None] * len(rares[0])] * 6]
            return pa.RecordBatch.from_arrays([pa.array(a + b, t) for a, b, t in zip(columns, more, types, strict=True)], names)

        keys, texts, size = [], [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                keys.append(key)
                texts.append(text.as_py() or b"")
                size += len(texts[-1])
                if size >= CHUNK or len(keys) >= 5000:
                    yield flushed(keys, texts)
                    keys, texts, size = [], [], 0
        if keys:
            yield flushed(keys, texts)

    schema = "rid long, token binary, k long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"
    rare = tokens.where((F.col("c") * MAX_FREQUENT < n) & (F.col("token") != END))
    rare_grams = chances.where(~is_frequent).select(F.concat(F.lit(b"\t"), F.unhex(F.lpad(F.hex("code"), 16, "0"))).alias("token"), F.lit(None).cast("long").alias("c"), "log")
    rare = rare.withColumn("log", F.lit(None).cast("double")).unionByName(rare_grams)
    joined = docs.mapInArrow(scan, schema).join(rare, "token", "left")
    main = F.col("n_tokens").isNotNull()
    log_of = F.col("k") * F.log10((F.coalesce("c", F.lit(0)) + 0.1) / F.lit(rest))
    sums = joined.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        F.sum(F.when(main, F.col("n_known")).when(F.col("c").isNotNull(), F.col("k"))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        F.sum(F.when(main, F.col("base")).when(F.col("log").isNull(), log_of)).alias("base_score"),
        F.sum(F.when(main, F.col("score")).otherwise(F.col("k") * F.col("log"))).alias("score"),
    )
    return sums.drop("rid")
