"""BPE against the tokenizers library, and a slow merge loop."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quiltgraph.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "hello world", "I'm the 123 ABC's <|endoftext|>x <|startoftext|> y<|endoftext|>", "ΣΑΣ İstanbul ǅ ﬁ éa", "a\x1cb\x85c\xa0d e",
    "\x00\x01 � 😀😀 👨‍👩‍👧", "<|EndOfText|> <|endoftext", "'S 'T'll", "ß ẞ Ⅷ ½ ²", "́ a", "x" * 5000, "le été " * 9000,
]


@pytest.fixture(scope="module")
def library() -> Tokenizer:
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def test_matches_the_library(spark, library):
    rng = random.Random(5)
    letters = "aAeEioé ñç'sßtThΣ.,!  12\n<|>"
    texts = TEXTS + ["".join(rng.choices(letters, k=rng.randint(1, 300))) for _ in range(200)]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(0, None, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = sorted((r.doc_id, tuple(r.ids), r.decoded) for r in bpe.encoded(df, PATH).collect())
    expected = []
    for i, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        expected.append((i, tuple(ids), library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(expected)


def test_a_small_cache_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 3)
    own = bpe.Encoder(PATH)
    text = "the cat sat on the mat, the cat's hat sat " * 20
    assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_queue_matches_a_slow_loop():
    rng = random.Random(6)
    ranks, wholes = {}, []
    symbols = list(range(4))
    for rank in range(40):
        pair = rng.choice(symbols), rng.choice(symbols)
        if pair[0] << 32 | pair[1] not in ranks:
            ranks[pair[0] << 32 | pair[1]] = len(wholes)
            wholes.append(100 + rank)
            symbols.append(100 + rank)
    for _ in range(300):
        ids = [rng.randrange(4) for _ in range(rng.randint(1, 30))]
        slow = list(ids)
        while True:
            found = [(ranks[a << 32 | b], i) for i, (a, b) in enumerate(zip(slow, slow[1:], strict=False)) if a << 32 | b in ranks]
            if not found:
                break
            rank, i = min(found)
            slow[i : i + 2] = [wholes[rank]]
        assert bpe.merged(list(ids), ranks, wholes) == slow


def test_empty_table(spark):
    assert bpe.encoded(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
