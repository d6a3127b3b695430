"""The prefix tree against the conversations that went in."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quiltgraph.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string, node string"


def some_turns():
    rng = random.Random(21)
    pieces = [*C.CONTROL, "\\", "<", "[", "hello", " ", "\n", "é😀", "/s>", "INST]", "<|"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 6))) for _ in range(6)]
    convs = {}
    for i in range(60):
        convs[i] = [(k, ("user", "assistant", "system")[k % 3 if i % 7 else 1], texts[rng.randrange(2 if k < 2 else 6)]) for k in range(rng.randint(1, 6))]
    convs[70] = convs[3]
    convs[80] = [(None, None, None), (1, "assistant", None), (1, "assistant", None), (1, "assistant", "long " * 20000)]
    return convs


def frame(spark, convs):
    rows = [(c, t, r, x, "clash") for c, turns in convs.items() for t, r, x in turns]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_everything_reads_back(spark):
    convs = some_turns()
    read = {r.conv_id: r for r in C.read_back(C.tree(frame(spark, convs))).collect()}
    assert read.keys() == convs.keys()
    for c, turns in convs.items():
        assert [(t.role, t.text) for t in read[c].turns] == [(r or "", x or "") for _, r, x in turns]
        assert read[c].losses == [x or "" for _, r, x in turns if r == "assistant"]


def test_nodes_are_emitted_once_depth_first(spark):
    convs = some_turns()
    made = C.tree(frame(spark, convs))
    nodes = sorted(made.nodes.collect(), key=lambda n: n.start)
    assert len(nodes) == len({tuple((r or "", x or "") for _, r, x in turns[: k + 1]) for turns in convs.values() for k in range(len(turns))})
    end, open_ = 0, []
    for n in nodes:
        assert n.start == end and n.end - n.start == len(n.text)
        end = n.end
        open_ = open_[: n.depth]
        assert [(a.start, a.end) for a in n.ancestors] == open_
        assert n.position == sum(b - a for a, b in open_)
        open_.append((n.start, n.end))


def test_no_control_string_is_left_in_a_text(spark):
    texts = [t for turns in some_turns().values() for _, _, t in turns if t] + ["<" * 3 + "s>", "<<SYS>><s>", "[[INST]", "\\\\<s>\\"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.escaped(F.col("t")).alias("e"), C.unescaped(C.escaped(F.col("t"))).alias("u")).collect()
    for r in got:
        assert r.u == r.t and not any(x in r.e for x in C.CONTROL)


def test_hot_first_turn(spark, monkeypatch):
    monkeypatch.setattr(C, "PARTS", 3)
    convs = {i: [(0, "user", "hello"), (1, "assistant", f"answer {i % 40}"), (2, "user", f"more {i}")] for i in range(200)}
    made = C.tree(frame(spark, convs))
    nodes = made.nodes.collect()
    assert len(nodes) == 1 + 40 + 200
    assert all(len(n.ancestors) == n.depth and (not n.depth or (n.ancestors[0].start, n.position > 0) == (0, True)) for n in nodes)
    read = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in C.read_back(made).collect()}
    assert read == {c: [(r, x) for _, r, x in turns] for c, turns in convs.items()}


def test_empty_table(spark):
    made = C.tree(spark.createDataFrame([], SCHEMA))
    assert made.nodes.count() == made.members.count() == 0
