"""Chat formatting over a prefix tree of turns.

Conversations that share their first turns share those nodes of the tree. A
node's id is a chain of hashes over the turns that lead to it, so shared turns
find one another without comparing conversations. The nodes' texts are
emitted once each, depth first: different conversations are sorted by their
paths, which puts those with a common start side by side, and a node stands
where the first conversation through it stands. Every node carries its place
in the output, the position of its first token within its conversation, and
the intervals of the output that it may attend to, those of its ancestors.
Tokens are code points of the formatted text.

Copies of a conversation collapse before the sort, offsets are summed by range
partition, and joins deal a turn of very many conversations to several parts,
so no tree, however popular its first turn, meets in one task.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quiltgraph.llm.common import checkpointed

TURN, SEP, DONE = "<|turn|>", "<|sep|>", "<|end|>"
#: Control strings of this and other templates. None is left within an escaped text.
CONTROL = (TURN, SEP, DONE, "<|im_start|>", "<|im_end|>", "<|startoftext|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TRAINED_ROLE = "assistant"
#: Parts of a hot key.
PARTS = 64
_ESCAPED = "([<\\[])(" + "|".join("".join("\\" + c if not c.isalnum() else c for c in x[1:]) for x in CONTROL) + ")"


class Tree(NamedTuple):
    """``nodes``: ``(node, start, end, depth, position, text, loss_start, loss_end, ancestors)`` by ``start``;
    ``members``: ``(conv_id, node)``, the last node of each conversation."""

    nodes: DataFrame
    members: DataFrame


def escaped(text: Column) -> Column:
    """Backslashes doubled, and one put after the first character of each control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(_ESCAPED), F.lit(r"$1\\$2"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"(?s)\\(.)"), F.lit("$1"))


def _paths(turns: DataFrame) -> DataFrame:
    """``(conv_id, path, nodes)``: a conversation's nodes with ids, texts and positions."""
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def step(done: Column, turn: Column) -> Column:
        head = F.concat(F.lit(TURN), escaped(turn["role"]), F.lit(SEP))
        body = escaped(turn["text"])
        text = F.concat(head, body, F.lit(DONE))
        node = F.md5(F.concat(done["node"], F.md5(text)))
        trained = turn["role"] == TRAINED_ROLE
        entry = F.struct(
            node.alias("node"),
            F.size(done["nodes"]).alias("depth"),
            done["position"].alias("position"),
            text.alias("text"),
            F.when(trained, F.length(head)).cast("long").alias("loss_start"),
            F.when(trained, F.length(head) + F.length(body)).cast("long").alias("loss_end"),
        )
        return F.struct(node.alias("node"), F.concat(done["path"], node).alias("path"), (done["position"] + F.length(text)).alias("position"), F.concat(done["nodes"], F.array(entry)).alias("nodes"))

    none = F.array().cast("array<struct<node:string,depth:int,position:bigint,text:string,loss_start:bigint,loss_end:bigint>>")
    start = F.struct(F.lit("").alias("node"), F.lit("").alias("path"), F.lit(0).cast("long").alias("position"), none.alias("nodes"))
    return rows.select("conv_id", F.aggregate("turns", start, step).alias("walk")).select("conv_id", "walk.node", "walk.path", "walk.nodes")


def tree(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Tree:
    """The prefix tree of all conversations.

    Null roles and texts count as empty. Rows of a conversation are ordered by
    turn, then role, then text; a null turn comes first, and repeated rows are
    repeated turns. Rows without an id form one conversation. An empty table
    has no nodes and no members. Further columns are ignored. A conversation,
    not a tree, must fit in a task.
    """
    turns = conversations.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    paths = _paths(turns)
    distinct = paths.groupBy("node").agg(F.first("path").alias("path"), F.first("nodes").alias("nodes"))
    placed = checkpointed(distinct.repartitionByRange("path").sortWithinPartitions("path").select("nodes"))
    # the partitions are fixed now, so this id follows the order of the paths
    ranked = placed.select(F.monotonically_increasing_id().alias("rank"), "nodes")
    passed = ranked.select("rank", F.inline("nodes"))
    merged = passed.groupBy("node").agg(F.min("rank").alias("rank"), *[F.first(c).alias(c) for c in ("depth", "position", "text", "loss_start", "loss_end")])
    sized = merged.withColumn("size", F.length("text").cast("long")).withColumn("part", F.shiftright("rank", 33))
    totals = sized.groupBy("part").agg(F.sum("size").alias("all"))
    before = totals.select("part", (F.sum("all").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("all")).alias("base"))
    upto = F.sum("size").over(W.partitionBy("part").orderBy("rank", "depth").rowsBetween(W.unboundedPreceding, 0))
    emitted = sized.withColumn("upto", upto).join(F.broadcast(before), "part")  # a row for each partition
    starts = checkpointed(emitted.select("node", "rank", (F.col("base") + F.col("upto") - F.col("size")).alias("start"), (F.col("base") + F.col("upto")).alias("end"), "depth", "position", "text", "loss_start", "loss_end"))
    ways = dealt(passed.select("rank", "node"), starts.select("node", "start", "end"), "node", "rank").groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("way"))
    nodes = starts.join(ways, "rank").select("node", "start", "end", "depth", "position", "text", "loss_start", "loss_end", F.slice("way", F.lit(1), F.col("depth")).alias("ancestors"))
    return Tree(nodes, paths.select("conv_id", "node"))


def dealt(many: DataFrame, one: DataFrame, key: str, other: str) -> DataFrame:
    """``many`` joined by ``key`` to ``one``, which has a row for each key.

    A key on over a thousandth of ``many``, such as a first turn of very many
    conversations, is dealt to ``PARTS`` parts by ``other``, with a copy of its
    row in each. There are 1,000 such keys at most, and only they are broadcast.
    """
    counts = checkpointed(many.groupBy(key).agg(F.count("*").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.broadcast(counts.where((F.col("n") * 1000 > total) & (F.col("n") > PARTS)).select(key, F.lit(True).alias("hot")))
    parted = many.join(hot, key, "left").withColumn("part", F.when(F.col("hot"), F.pmod(F.xxhash64(other), F.lit(PARTS))).otherwise(F.lit(0).cast("long")))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("hot"), F.lit(PARTS - 1)).otherwise(F.lit(0)).cast("long")))
    copied = one.join(hot, key, "left").withColumn("part", copies)
    return parted.drop("hot").join(copied.drop("hot"), [key, "part"]).drop("part")


def read_back(made: Tree) -> DataFrame:
    """``(conv_id, turns, losses, formatted_chars)`` as read from the emitted nodes.

    A conversation is what its last node attends to and that node itself; its
    turns are parsed from the text, its losses cut out by the mask.
    """
    segments = made.nodes.select(F.col("start").alias("at"), "text", "loss_start", "loss_end")
    seen = made.nodes.select("node", F.explode(F.concat("ancestors", F.array(F.struct("start", "end")))).alias("seen"))
    last = made.members.select("node").distinct()
    wanted = seen.join(last, "node", "left_semi").select("node", F.col("seen.start").alias("at"))
    joined = dealt(wanted, segments, "at", "node").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("at", "text", "loss_start", "loss_end"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    whole = joined.select("node", "parts", text.alias("formatted"))
    pieces = F.filter(F.split("formatted", r"<\|turn\|>"), lambda x: x != "")
    parsed = F.transform(pieces, lambda x: F.struct(unescaped(F.substring_index(x, SEP, 1)).alias("role"), unescaped(F.replace(F.substring_index(x, SEP, -1), F.lit(DONE), F.lit(""))).alias("text")))
    losses = F.transform(F.filter("parts", lambda p: p["loss_start"].isNotNull()), lambda p: unescaped(F.substring(p["text"], p["loss_start"].cast("int") + 1, (p["loss_end"] - p["loss_start"]).cast("int"))))
    read = whole.select("node", parsed.alias("turns"), losses.alias("losses"), F.length("formatted").cast("long").alias("formatted_chars"))
    return made.members.join(read, "node").select("conv_id", "turns", "losses", "formatted_chars")
