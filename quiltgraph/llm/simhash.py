"""SimHash near-duplicates: pigeonhole blocks, then Hamming distance.

A fingerprint of 64 bits is cut into five blocks. Two fingerprints that
differ in at most three bits agree on at least two whole blocks, so each
fingerprint is filed under the ten pairs of blocks and only those filed
together are compared. Keys hold 25 or 26 bits, so a key gathers
fingerprints at about N / 2**25, not N / 2**16 as single blocks would.

Hot keys: exact copies share one fingerprint and are collapsed before
anything is filed. A key with more than ``HOT_KEY`` different fingerprints
is filed again under each quarter of its remaining bits, and so on until no
key is hot; by the same pigeonhole argument no pair is lost. Within a key only
a spanning forest of its links leaves the task, never all pairs.

``similar_groups`` finds what is alike by Jaccard similarity instead: first
from blocks of a wider fingerprint, then, exactly, from the rarest runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltgraph.llm.common import checkpointed, gram_hashes, small

BITS = 64
DISTANCE = 3
SHINGLE = 3
SEED = 42
HOT_KEY = 4096
TASK_LINKS = 100_000
BROADCAST_LINKS = 500_000
#: After so many rounds a hot key leaves ``BITS_LEFT`` bits open at most, and holds no more than ``2 ** BITS_LEFT`` fingerprints.
ROUNDS, BITS_LEFT = 4, 13
#: Bits of a wide fingerprint, how many of the 64 compared may differ, the members of a block that are compared at once, and the blocks whose pairs are verified first.
WIDE, WIDE_CHECK, HOT_WIDE, EARLY = 1024, 18, 1024, 8
_MULTIPLIERS = (np.arange(1, WIDE // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
#: Members of a hot key that are in each of its parts, where it can't be split on more bits. What they don't connect, ``_unlinked`` compares.
SHARED = 32
#: Runs are counted in one row of so many, or about ``SAMPLE`` rows where that is more; the count from which a run is frequent there; how many such runs are ranked. They order the runs; no result hangs on them.
ONE_OF, SAMPLE, FREQUENT, RANKED = 8, 5000, 3, 1 << 18
#: Lowest bit and width of each of the five blocks.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of a text in UTF-8 over its word shingles; 0 without words."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    hash_of = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return hash_of(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    spans = zip((ends - sizes)[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    hashes = np.array([hash_of(joined[a:b], SEED) for a, b in spans], dtype="<u8")
    set_in = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)``, a row for each row of ``docs``; null texts have no words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(scan, "doc_id long, fp long")


def _masks() -> list[int]:
    """The bits of each pair of blocks."""
    blocks = [((1 << width) - 1) << low for low, width in BLOCKS]
    return [a | b for a, b in combinations(blocks, 2)]


def _finer(mask: int) -> list[int]:
    """``mask`` with each quarter of the bits that it leaves open."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    return [mask | sum(1 << int(b) for b in part) for part in np.array_split(free, 4)]


def _signed(number: int) -> int:
    return number - (number >> 63 << 64)


def _forest(checks: np.ndarray, cuts: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Shortest spanning forest of the links within each run; ``cuts``: the run of each row."""
    n = len(checks)
    at, pairs = np.arange(n - 1), []
    for gap in range(1, n):
        at = at[at + gap < n]
        at = at[cuts[at] == cuts[at + gap]]
        if not len(at):
            break
        far = np.bitwise_count(checks[at] ^ checks[at + gap])
        near = far <= distance
        pairs.append((at[near].astype(np.int32), np.full(int(near.sum()), gap, np.int32), far[near]))
    left, right = [], []
    if not pairs:
        return left, right
    first, gaps, far = (np.concatenate(x) for x in zip(*pairs, strict=True))
    label = np.arange(n)
    for d in range(distance + 1):
        here = far == d
        a, b = first[here], first[here] + gaps[here]
        while len(a):
            open_ = label[a] != label[b]
            a, b = a[open_], b[open_]
            root = label.tolist()

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for i, j in zip(a[:n].tolist(), b[:n].tolist(), strict=True):
                x, y = find(i), find(j)
                if x != y:
                    root[max(x, y)] = min(x, y)
                    left.append(i)
                    right.append(j)
            a, b = a[n:], b[n:]
            label = np.array([find(x) for x in range(n)])
    return left, right


def _compared(rows: DataFrame, distance: int, hot: int, last: bool = False) -> DataFrame:
    """``(a, b, file, check)`` from ``(key, node, check, file)``.

    Nodes under one key whose checks differ in at most ``distance`` bits are
    linked, ``a`` over ``b``: a spanning forest of each key. Rows of keys with
    over ``hot`` of them come back as they are, ``a`` the node and ``b`` null;
    on the ``last`` call they are compared ``hot`` at a time, with the first
    ``SHARED`` of the key in each part, which is no whole comparison: the caller
    must have an exact way for the rest. A task holds ``hot`` rows and a batch.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, over, shared = [np.empty(0, np.int64)] * 4, None, [np.empty(0, np.int64)] * 4

        def linked(part: list[np.ndarray]) -> pa.RecordBatch:
            keys, nodes, checks, files = part
            cuts = np.cumsum(np.r_[0, keys[1:] != keys[:-1]]) if len(keys) else keys
            left, right = _forest(checks.view(np.uint64), cuts, distance)
            a, b = nodes[left], nodes[right]
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b)), pa.array(files[left]), pa.nulls(len(a), pa.int64())], ["a", "b", "file", "check"])

        def handed(part: list[np.ndarray]) -> pa.RecordBatch:
            _, nodes, checks, files = part
            if last:
                return linked([np.concatenate([x, y]) for x, y in zip(shared, part, strict=True)])
            return pa.RecordBatch.from_arrays([pa.array(nodes), pa.nulls(len(nodes), pa.int64()), pa.array(files), pa.array(checks)], ["a", "b", "file", "check"])

        def cut(part: list[np.ndarray], at: slice | np.ndarray) -> list[np.ndarray]:
            return [x[at] for x in part]

        for batch in batches:
            part = [np.concatenate([x, np.asarray(batch.column(i))]) for i, x in enumerate(held)]
            if over is not None:  # the rest of a hot key
                n = int((part[0] == over).sum())
                for i in range(0, n, hot):
                    yield handed(cut(part, slice(i, min(i + hot, n))))
                part = cut(part, slice(n, None))
            if not len(part[0]):
                held = part
                continue
            keys = part[0]
            begins = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1]
            sizes = np.diff(np.r_[begins, len(keys)])
            big = sizes > hot
            for begin, size in zip(begins[big].tolist(), sizes[big].tolist(), strict=True):
                whole = cut(part, slice(begin, begin + size))
                shared = cut(whole, slice(None, SHARED if last else 0))
                for i in range(0, size, hot):
                    yield handed(cut(whole, slice(i, i + hot)))
            over = int(keys[-1]) if big[-1] else None
            small = np.repeat(~big & (sizes > 1), sizes)
            if over is None:  # the last key may go on in the next batch
                small[begins[-1] :] = False
                held = cut(part, slice(begins[-1], None))
            else:
                held = cut(part, slice(len(keys), None))
            if small.any():
                yield linked(cut(part, small))
        if len(held[0]) > 1:
            yield linked(held)

    dealt = rows.select("key", "node", "check", "file").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(scan, "a long, b long, file long, check long")


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``(a, b)``: links that connect all fingerprints within ``distance``.

    Every pair of different fingerprints at that distance is compared; the
    links returned are spanning forests of those found under one key.
    """
    if distance > DISTANCE:
        raise ValueError(f"five blocks prove a distance of {DISTANCE} at most")
    found, rows, masks, rounds = None, fps.select(F.col("fp").alias("node")), [(0, m) for m in _masks()], 0
    while True:
        filed = F.col("node").bitwiseAND(F.col("file"))
        if found is None:
            rows = rows.withColumn("file", F.explode(F.array(*[F.lit(_signed(m)) for _, m in masks])))
        else:
            finer = fps.sparkSession.createDataFrame([(_signed(a), _signed(b)) for a, b in masks], "mask long, file long")
            rows = hot.join(F.broadcast(finer), "mask").select("node", "file")  # at most 10 * 4 ** round masks
        out = checkpointed(_compared(rows.select(F.xxhash64("file", filed).alias("key"), "node", F.col("node").alias("check"), "file"), distance, HOT_KEY if rounds < ROUNDS else 1 << BITS_LEFT))
        rounds += 1
        here = out.where("b IS NOT NULL").select("a", "b")
        found = here if found is None else found.unionByName(here)
        hot = out.where("b IS NULL").select(F.col("file").alias("mask"), F.col("a").alias("node"))
        masks = [(r.mask % (1 << BITS), m) for r in hot.select("mask").distinct().collect() for m in _finer(r.mask % (1 << BITS))]
        if not masks:
            return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of connected components: large-star and small-star in turn.

    Rounds grow with the logarithm of the longest chain. Only a count and a
    checksum of the links reach the driver; each round is checkpointed and
    runs on a task for every ``TASK_LINKS`` links that are left.
    """
    edges = checkpointed(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
        edges = edges.coalesce(1 + now[0] // TASK_LINKS)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(1 + now[0] // TASK_LINKS)
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"), F.count("*").alias("n"))
        large = _met(both.where("b > a"), least, now[0]).select(F.col("b").alias("a"), F.col("root").alias("b"))
        lower = large.groupBy("a").agg(F.min("b").alias("root"), F.count("*").alias("n"))
        lesser = _met(large, lower, now[0]).where("b != root").select(F.col("b").alias("a"), F.col("root").alias("b"))
        edges = checkpointed(lesser.unionByName(lower.select("a", F.col("root").alias("b"))).coalesce(1 + 2 * now[0] // TASK_LINKS).distinct())


def _met(edges: DataFrame, roots: DataFrame, total: int) -> DataFrame:
    """``edges`` with the root of their ``a``.

    Up to ``BROADCAST_LINKS`` links have twice as many nodes at most, which are
    broadcast. Beyond that, nodes with over a thousandth of ``total`` links,
    2,000 of them at most as each link has two ends, are broadcast, so that no
    hub meets in one task.
    """
    if total <= BROADCAST_LINKS:
        return edges.join(F.broadcast(roots.drop("n")), "a")
    hubs, rest = F.broadcast(roots.where(F.col("n") * 1000 > total).drop("n")), roots.where(F.col("n") * 1000 <= total).drop("n")
    return edges.join(hubs, "a").unionByName(edges.join(hubs.select("a"), "a", "left_anti").join(rest, "a"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``.

    Documents link when their fingerprints differ in at most ``distance``
    bits; ``component_id`` is the smallest doc_id reachable. Null and empty
    texts have fingerprint 0 and link like any other. Repeated rows keep a
    row each; rows without a doc_id get the component of their fingerprint,
    null where no row of it has one. Further columns are ignored.
    """
    fps = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    nodes = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes.select("fp"), distance))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    first = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(rooted.join(first, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """Hashes of the different runs of ``shingle`` words, sorted; a shorter text is one run."""
    words = text.lower().split() if text else []
    return np.unique(gram_hashes(words, min(shingle, len(words)))) if words else np.empty(0, np.uint64)


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """SimHash of ``WIDE`` bits: each word of 64 bits sees the hashes by a multiplier of its own."""
    ones = np.zeros(WIDE, dtype=np.int64)
    for start in range(0, len(hashes), 255):
        mixed = hashes[start : start + 255, None] * _MULTIPLIERS
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        ones += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").tobytes()


def _node(runs: np.ndarray) -> int:
    """The number of a set of runs."""
    return _signed(xxhash.xxh64_intdigest(runs.tobytes()))


def _wide(docs: DataFrame, shingle: int) -> DataFrame:
    """``(row, node, wide)`` of ``(row, text)``: the number of its set of runs and the wide fingerprint."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, found = [], []
            for text in batch.column(1).cast(pa.binary()):
                runs = shingle_hashes(text.as_py(), shingle)
                nodes.append(_node(runs))
                found.append(wide_fingerprint(runs))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(found, pa.binary())], ["row", "node", "wide"])

    return docs.mapInArrow(scan, "row long, node long, wide binary")


def _wide_keys(nodes: DataFrame) -> DataFrame:
    """``(node, check, file)``: a row for each block, whose number and bits, with those that follow them, are ``file``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_blocks = WIDE // 16
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                n = part.num_rows
                wide = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(n, WIDE // 8)
                ring = np.concatenate([wide, wide[:, :7]], axis=1).astype(np.int64)
                files = np.tile(np.arange(n_blocks), (n, 1))
                for k in range(7):
                    files = files << 8 | ring[:, k : k + WIDE // 8 : 2]
                words = wide.view(np.int64)
                checks = words[:, (np.arange(n_blocks) // 4 + words.shape[1] // 2) % words.shape[1]]  # never the word that the block is of
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(part.column(0)), n_blocks)), pa.array(checks.ravel()), pa.array(files.ravel())], ["node", "check", "file"])

    return nodes.select("node", "wide").mapInArrow(scan, "node long, check long, file long")


def _candidates(nodes: DataFrame) -> DataFrame:
    """``(a, b, block)``: pairs of nodes that share a block and are near by 64 other bits; the first such block."""
    rows, found = _wide_keys(nodes), None
    for more in range(6):
        key = F.shiftright("file", 40 - 8 * more)
        out = checkpointed(_compared(rows.withColumn("key", key), WIDE_CHECK, HOT_WIDE, last=more == 5))
        here = out.where("b IS NOT NULL AND a != b").select("a", "b", F.shiftright("file", 56).alias("block"))
        found = here if found is None else found.unionByName(here)
        rows = out.where("b IS NULL").select(F.col("a").alias("node"), "check", "file")
        if rows.isEmpty():
            break
    return found.groupBy("a", "b").agg(F.min("block").alias("block"))


def _frequent(texts: DataFrame, shingle: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs that are frequent in a sample of the ``total`` rows, sorted, and their counts.

    The sample is a share of the rows, not a number of them: what is frequent
    would otherwise take ever more rows, and the pairs that meet under a run
    grow with their square.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_hashes(text.as_py(), shingle).view(np.int64))], ["run"])

    sample = texts.where(F.pmod(F.xxhash64("row"), F.lit(max(1, min(ONE_OF, total // SAMPLE)))) == 0).select("text")
    counted = checkpointed(sample.mapInArrow(scan, "run long").groupBy("run").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT))
    least, ranked = 1 << 62, 0
    for n, k in sorted(counted.groupBy("n").agg(F.count("*").alias("k")).collect(), reverse=True):
        ranked += k
        if ranked > RANKED:
            break
        least = n
    top = counted.where(F.col("n") >= least).toArrow()
    runs, counts = top["run"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(runs)
    return runs[order], counts[order]


def _rarest(runs: np.ndarray, similarity: float, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first runs of a set, rare ones first: sets at ``similarity`` have one of these in common."""
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, runs), len(frequent) - 1)
        rank = np.where(frequent[at] == runs, counts[at], 0)
        if rank.any():
            runs = runs[np.argsort(rank, kind="stable")]
    return runs[: len(runs) - int(np.ceil(similarity * len(runs) - 1e-9)) + 1]


def _parities(runs: np.ndarray, bins: int) -> bytes:
    """A bit for each of ``bins`` bins, a power of two, by whether an odd number of runs is in it."""
    count = np.bincount((runs >> np.uint64(20) & np.uint64(bins - 1)).astype(np.int64), minlength=bins)
    return np.packbits((count & 1).astype(np.uint8)).tobytes()


def _posted(texts: DataFrame, shingle: int, similarity: float, frequent: np.ndarray, counts: np.ndarray) -> DataFrame:
    """``(key, node, root)`` of ``(text, root)``: a row for each of the rarest runs; a null root is the node itself.

    A node is posted once a task at most times, whatever its copies.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                keys, nodes, roots = [np.empty(0, np.uint64)], [], []
                for text, root in zip(part.column(0).cast(pa.binary()), part.column(1).to_pylist(), strict=True):
                    runs = shingle_hashes(text.as_py(), shingle)
                    node = _node(runs)
                    if not len(runs) or node in seen:
                        continue
                    if len(seen) >= 1 << 20:
                        seen.clear()
                    seen.add(node)
                    keys.append(_rarest(runs, similarity, frequent, counts))
                    nodes.append(node)
                    roots.append(node if root is None else root)
                sizes = [len(k) for k in keys[1:]]
                columns = [np.concatenate(keys).view(np.int64), np.repeat(np.array(nodes, np.int64), sizes), np.repeat(np.array(roots, np.int64), sizes)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "node", "root"])

    return texts.select("text", "root").mapInArrow(scan, "key long, node long, root long")


def _met_apart(posts: DataFrame) -> DataFrame:
    """The different rows of ``posts`` whose key has two roots, and of keys with over ``HOT_WIDE`` rows."""
    hot = HOT_WIDE

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, over = [np.empty(0, np.int64)] * 3, None
        for batch in batches:
            part = [np.concatenate([x, np.asarray(batch.column(i))]) for i, x in enumerate(held)]
            keys, roots = part[0], part[2]
            if not len(keys):
                continue
            begins = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1]
            sizes = np.diff(np.r_[begins, len(keys)])
            kept = np.repeat((np.minimum.reduceat(roots, begins) != np.maximum.reduceat(roots, begins)) | (sizes > hot), sizes)
            if over is not None:  # the rest of a hot key
                kept |= keys == over
            end = int(begins[-1])  # the last key may go on in the next batch
            if sizes[-1] > hot or keys[-1] == over:
                over, end = int(keys[-1]), len(keys)
            held = [x[end:] for x in part]
            kept = np.flatnonzero(kept[:end])
            yield pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in part], ["key", "node", "root"])
        roots = held[2]
        if len(roots) and roots.min() != roots.max():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["key", "node", "root"])

    return posts.repartition("key").sortWithinPartitions("key").mapInArrow(scan, "key long, node long, root long").distinct()


def _apart(met: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """``(a, b, root_a, root_b, far)``: each pair of nodes of different roots under one key that may be at ``similarity``.

    ``far`` is the least that the two sets can differ by: the difference of
    their sizes, or the bits by which the parities of their runs in 1,024 bins
    differ. At ``similarity`` it is a bounded share of both sizes, so no pair
    is lost. Keys of over ``HOT_WIDE`` nodes are dealt to parts, and every
    part meets every other in a task of its own.
    """
    hot, share = HOT_WIDE, (1 - similarity) / (1 + similarity)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(part: pa.RecordBatch) -> pa.RecordBatch:
            tiles, nodes, roots, parts, sizes = (np.asarray(part.column(i)) for i in range(5))
            same = np.asarray(part.column(5)).astype(bool)
            parities = np.frombuffer(b"".join(part.column(6).to_pylist()), np.uint64).reshape(len(nodes), 16)
            cuts = np.cumsum(np.r_[0, tiles[1:] != tiles[:-1]])
            at, found = np.arange(len(nodes) - 1), [np.empty((3, 0), np.int64)]
            for gap in range(1, len(nodes)):
                at = at[at + gap < len(nodes)]
                at = at[cuts[at] == cuts[at + gap]]
                if not len(at):
                    break
                x = at[(roots[at] != roots[at + gap]) & (same[at] | (parts[at] != parts[at + gap]))]
                y = x + gap
                far = np.maximum(np.bitwise_count(parities[x] ^ parities[y]).sum(axis=1, dtype=np.int64), np.abs(sizes[x] - sizes[y]))
                near = far <= (sizes[x] + sizes[y]) * share + 1e-6
                found.append(np.stack([x[near], y[near], far[near]]))
            x, y, far = np.concatenate(found, axis=1)
            x, y = np.where(nodes[x] > nodes[y], x, y), np.where(nodes[x] > nodes[y], y, x)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (nodes[x], nodes[y], roots[x], roots[y], far)], ["a", "b", "root_a", "root_b", "far"])

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            if not table.num_rows:
                continue
            tiles = table.column(0).to_numpy()
            begins = np.flatnonzero(tiles != tiles[-1])  # the last tile may go on in the next batch
            end = int(begins[-1]) + 1 if len(begins) else 0
            if end:
                yield pairs(table.slice(0, end).combine_chunks().to_batches()[0])
            held = table.slice(end).combine_chunks().to_batches()[0]
        if held is not None:
            yield pairs(held)

    keys = met.groupBy("key").agg(F.ceil(F.count("*") / hot).cast("int").alias("parts"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    keys = small(checkpointed(keys.where("lo != hi").select("key", "parts")))
    rows = met.join(keys, "key").join(sketches, "node").withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("long"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tile = F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other"))
    rows = rows.select(tile.alias("tile"), "node", "root", "part", "size", (F.col("part") == F.col("other")).cast("long").alias("same"), "parities")
    out = rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(scan, "a long, b long, root_a long, root_b long, far long")
    return out.distinct()


def similar_groups(docs: DataFrame, row_col: str, text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``(row, group)`` for every row of ``docs``; ``group``: the same number for all rows of a component.

    Texts link when the Jaccard similarity of their sets of ``shingle``-word
    runs, in lower case, is ``similarity`` or more. Every link counts, and only
    links do. Texts of one set are one; null and empty texts are alike.

    Most links are found quickly: candidates share one of the 64 blocks of a
    SimHash of 1,024 bits and differ in at most ``WIDE_CHECK`` of 64 other
    bits; of each block the closest pairs that connect it are held against both
    sets, first those of ``EARLY`` blocks, then those of the others that are
    not connected yet. A block with over ``HOT_WIDE`` fingerprints is split on
    the 8 bits that follow, up to five times, and then compared in parts.

    The rest is exact: sets at ``similarity`` have one of their rarest runs in
    common, so every pair that has, is not connected yet and isn't ruled out by
    sizes and parities is held against both sets, nearest ones first.
    ``row_col`` must tell rows apart and not be null. Further columns are ignored.
    """
    texts = docs.select(F.col(row_col).cast("long").alias("row"), F.col(text_col).alias("text"))
    wide = checkpointed(_wide(texts, shingle))
    nodes = checkpointed(wide.groupBy("node").agg(F.min("row").alias("row"), F.first("wide").alias("wide")))
    pairs = checkpointed(_candidates(nodes))

    def texts_of(some: DataFrame) -> DataFrame:
        ends = checkpointed(some.distinct().join(nodes.select("node", "row"), "node"))
        return texts.join(small(ends), "row").select("node", "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(t.as_py(), shingle).view(np.int64) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "runs"])

    def sets_of(some: DataFrame) -> DataFrame:
        """``(node, runs)`` of some nodes."""
        return checkpointed(texts_of(some).mapInArrow(scan, "node long, runs array<long>"))

    def ends_of(some: DataFrame) -> DataFrame:
        return some.select(F.explode(F.array("a", "b")).alias("node"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, least, most = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                runs = shingle_hashes(text.as_py(), shingle)
                sizes.append(len(runs))
                least.append(_parities(runs, 1024))
                most.append(_parities(runs, max(1024, 1 << (len(runs) - 1).bit_length())))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(least, pa.binary()), pa.array(most, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["node", "size", "parities", "bins"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = (1 - similarity) / (1 + similarity)
        for batch in batches:
            sizes = np.asarray(batch.column(7))
            kept = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(batch.column(5), batch.column(6), strict=True)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                bins = min(len(x), len(y))  # the bins of one are folded to those of the other
                x, y = (np.bitwise_xor.reduce(z.reshape(-1, bins), axis=0) for z in (x, y))
                kept[i] = int(np.bitwise_count(x ^ y).sum(dtype=np.int64)) <= sizes[i] * share + 1e-6
            yield batch.filter(pa.array(kept)).select([0, 1, 2, 3, 4])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.asarray(x.values), np.asarray(y.values)
                both = len(np.intersect1d(x, y, assume_unique=True))
                kept[i] = both >= similarity * (len(x) + len(y) - both)
            yield batch.filter(pa.array(kept)).select([0, 1])

    def linked(some: DataFrame, sets: DataFrame) -> DataFrame:
        left = some.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("runs").alias("x")), "a")
        return left.join(sets.select(F.col("node").alias("b"), F.col("runs").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")

    def unconnected(some: DataFrame, roots: DataFrame) -> DataFrame:
        end = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"now_{c}"))
        return some.join(end("a"), "a", "left").join(end("b"), "b", "left").where(F.coalesce("now_a", "a") != F.coalesce("now_b", "b"))

    def and_links(roots: DataFrame, more: DataFrame) -> DataFrame:
        return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))

    sets = sets_of(ends_of(pairs))
    early = components(linked(pairs.where(F.col("block") < EARLY), sets))
    roots = and_links(early, linked(unconnected(pairs.where(F.col("block") >= EARLY), early), sets))

    moved = small(checkpointed(wide.join(roots, "node").where("node != root").select("row", "root")))
    posts = _posted(texts.join(moved, "row", "left"), shingle, similarity, *_frequent(texts, shingle, wide.count()))
    met = checkpointed(_met_apart(posts))
    sketches = checkpointed(texts_of(met.select("node")).mapInArrow(sketch, "node long, size long, parities binary, bins binary"))
    rest = checkpointed(_apart(met, sketches.drop("bins"), similarity).join(pairs.select("a", "b"), ["a", "b"], "left_anti"))  # of what blocks found, only failures are unconnected
    end = lambda c: sketches.select(F.col("node").alias(c), F.col("bins").alias(f"bins_{c}"), F.col("size").alias(f"size_{c}"))
    rest = rest.join(end("a"), "a").join(end("b"), "b").select("a", "b", "root_a", "root_b", "far", "bins_a", "bins_b", (F.col("size_a") + F.col("size_b")).alias("sizes"))
    rest = checkpointed(rest.mapInArrow(near, "a long, b long, root_a long, root_b long, far long"))  # long texts by as many bins as they have runs
    sets = sets_of(ends_of(rest))
    nearest = rest.groupBy(F.least("root_a", "root_b"), F.greatest("root_a", "root_b")).agg(F.min(F.struct("far", "a", "b")).alias("pair"))
    nearest = checkpointed(nearest.select("pair.a", "pair.b"))
    roots = and_links(roots, linked(nearest, sets))
    roots = and_links(roots, linked(unconnected(rest, roots).join(nearest, ["a", "b"], "left_anti"), sets))
    return wide.join(roots, "node", "left").select("row", F.coalesce("root", "node").alias("group"))
