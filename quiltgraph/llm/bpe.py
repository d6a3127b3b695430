"""BPE encoding and decoding.

A word's symbols form a doubly linked list. The merge rank of every
neighbouring pair waits in a priority queue; an entry taken out is stale, and
skipped, when its symbols have merged with others meanwhile. Decoding
concatenates the vocabulary's strings.

Text between white space is encoded by itself, as no token of the vocabulary
file crosses it, so a task keeps what it has encoded lately in two generations
of bounded size. The vocabulary file is read by every worker; its path is a
parameter.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import cache
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of each of the two generations of encoded pieces.
KEPT = 150_000


@cache
def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable, else the next code point from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


def merged(ids: list[int], ranks: dict[int, int], wholes: list[int]) -> list[int]:
    """``ids`` after all merges, lowest rank and leftmost first.

    ``ranks``: the merge rank of a pair packed as ``left << 32 | right``;
    ``wholes``: what the merge of each rank makes. A queue entry packs rank
    and position. It is stale if the pair at that position now has another rank.
    """
    n = len(ids)
    rank_of, push, pop = ranks.get, heapq.heappush, heapq.heappop
    queue = [r << 32 | i for i in range(n - 1) if (r := rank_of(ids[i] << 32 | ids[i + 1], -1)) >= 0]
    if not queue:
        return ids
    heapq.heapify(queue)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    after[-1] = -1
    while queue:
        entry = pop(queue)
        i, rank = entry & 0xFFFFFFFF, entry >> 32
        j = after[i]
        if j < 0 or rank_of(ids[i] << 32 | ids[j]) != rank:
            continue
        ids[i] = whole = wholes[rank]
        ids[j] = -1
        k = after[i] = after[j]
        after[j] = -1
        if k >= 0:
            before[k] = i
            if (r := rank_of(whole << 32 | ids[k], -1)) >= 0:
                push(queue, r << 32 | i)
        h = before[i]
        if h >= 0 and (r := rank_of(ids[h] << 32 | whole, -1)) >= 0:
            push(queue, r << 32 | h)
    return [x for x in ids if x >= 0]


class Encoder:
    """A vocabulary file with word ends, read from ``path``.

    The file must name NFC, white space made one space, and lower case as its
    normalisation, and split words by a pattern that crosses no white space.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or model.get("byte_fallback"):
            raise ValueError(f"{path} is no vocabulary of lower-case words with word ends")
        vocab, self.end = model["vocab"], model["end_of_word_suffix"] or ""
        self.ranks = {vocab[a] << 32 | vocab[b]: rank for rank, (a, b) in enumerate(model["merges"])}
        self.wholes = [vocab[a + b] for a, b in model["merges"]]
        letters = byte_letters()
        self.inner = [vocab.get(letters[b], -1) for b in range(256)]
        self.last = [vocab.get(letters[b] + self.end, -1) for b in range(256)]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        #: What every special token starts with: a text without it has none.
        self.sign = commonprefix(list(self.special))
        self.parted = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.fresh: dict[str, list[int]] = {}
        self.old: dict[str, list[int]] = {}

    def word(self, word: str) -> list[int]:
        data = word.encode()
        ids = [*map(self.inner.__getitem__, data)]
        ids[-1] = self.last[data[-1]]
        if -1 in ids:  # letters that the vocabulary lacks are left out
            ids = [i for i in ids if i >= 0]
        return merged(ids, self.ranks, self.wholes)

    def piece(self, piece: str) -> list[int]:
        """Ids of a normalised text without white space."""
        ids = self.old.get(piece)
        if ids is None:
            if piece.isalpha():
                ids = self.word(piece)
            else:
                ids = [i for w in self.pattern.findall(piece) for i in (self.fresh.get(w) or self.old.get(w) or self.word(w))]
        if len(self.fresh) >= KEPT:
            self.fresh, self.old = {}, self.fresh
        self.fresh[piece] = ids
        return ids

    def plain(self, text: str) -> list[int]:
        """Ids of a text without special tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        pieces = regex.split(r"\s+", text) if regex.search(r"[\x1c-\x1f]", text) else text.split()
        out: list[int] = []
        known, add = self.fresh.get, out.extend
        for piece in pieces:
            ids = known(piece)
            if ids is None:
                ids = self.piece(piece) if piece else []
                known = self.fresh.get
            add(ids)
        return out

    def encode(self, text: str) -> list[int]:
        if not self.special or self.sign not in text:
            return self.plain(text)
        out: list[int] = []
        for part in self.parted.split(text):
            out.extend([self.special[part]] if part in self.special else self.plain(part))
        return out

    def decode(self, ids: list[int]) -> str:
        """The vocabulary's strings; the file names no decoder, so a space stands between them."""
        return " ".join(map(self.strings.__getitem__, ids))


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids, decoded)`` for every row: token ids, and the text that they decode to.

    ``path``: the vocabulary file, at the same place on every machine. Null
    counts as empty, and an empty text has no ids and decodes to an empty
    text. Whole texts are encoded, however long. Special tokens' strings in a
    text are special tokens. Repeated rows each get a row; further columns are
    ignored.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                ids = [np.array(bpe.encode(t.as_py() or ""), dtype=np.int32) for t in part.column(1)]
                decoded = pa.array([bpe.decode(x.tolist()) for x in ids], pa.string())
                offsets = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
                flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), decoded], ["doc_id", "ids", "decoded"])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(scan, "doc_id long, ids array<int>, decoded string")
