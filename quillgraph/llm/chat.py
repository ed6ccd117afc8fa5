"""Chat formatting of reply trees.

Messages form trees by parent. Iterative self-joins double ancestor pointers, so that a path of n messages takes log2(n)
joins; leaves are ranked in each conversation by the mean score on their path (then by length, then by id), and
the chosen paths are expanded back through the same pointers and formatted, one conversation each.

Format of a turn: `<|turn|>` role `<|says|>` text `<|end|>`. Control strings in roles and texts get one backslash after
their opening character, and one more where they already have some, which is undone on reading.

Defined cases: a null role or text is empty; equal turns are ordered by role, then text, and all kept; a null conversation id is a
conversation of its own; a parent that does not exist makes a root; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spark_util import cut

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: Control strings: an opening character, then one of these.
_BODY = r"(/?s>|\|[a-z_]+\|>|/?INST\]|</?SYS>>)"
_ESCAPE = re.compile(r"([<\[])(\\*)" + _BODY)
_UNESCAPE = re.compile(r"([<\[])\\(\\*)" + _BODY)
_TURN = re.compile(re.escape(TURN) + r"(.*?)" + re.escape(SAYS) + r"(.*?)" + re.escape(END), re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def escaped(c: Column) -> Column:
    """escape() on the JVM side."""
    return F.regexp_replace(c, _ESCAPE.pattern, r"$1\\$2$3")


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; [start, end) is the escaped text's place in code points."""
    return [(unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)) for m in _TURN.finditer(formatted)]


def reply_paths(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """(conv, leaf, rank, position, node): the messages on each chosen root-to-leaf path, roots first.

    messages: conv, node (long, unique in the conversation), parent (null at roots), score (null: 0).
    """
    m = messages.select("conv", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    ids = m.select(F.col("conv").alias("c"), F.col("node").alias("n"))
    tree = m.join(ids, m["conv"].eqNullSafe(ids["c"]) & (m["parent"] == ids["n"]) & (m["parent"] != m["node"]), "left").select("conv", "node", F.col("n").alias("up"), F.lit(0).cast("long").alias("depth"), "score")
    # tree.up is the ancestor 2^i above; depth and score sum what lies below it on the path, the node included
    # only unfinished rows join again, so a round costs what is left of the long paths, not every message
    state = cut(tree.select("conv", "node", "up", F.lit(1).cast("long").alias("depth"), "score"))
    done, active, levels = state.where("up is null"), state.where("up is not null"), []
    while not active.isEmpty():
        if len(levels) > 40:
            raise ValueError("the reply graph has a cycle")
        levels.append(active.select("conv", "node", "up"))
        a, b = active.alias("a"), done.union(active).alias("b")
        state = cut(
            a.join(b, F.col("a.conv").eqNullSafe(F.col("b.conv")) & (F.col("a.up") == F.col("b.node"))).select(
                "a.conv", "a.node", F.col("b.up").alias("up"), (F.col("a.depth") + F.col("b.depth")).alias("depth"), (F.col("a.score") + F.col("b.score")).alias("score")
            )
        )
        done, active = done.union(state.where("up is null")), state.where("up is not null")
    parents = tree.where("up is not null").select(F.col("conv").alias("c"), F.col("up").alias("u")).distinct()
    leaves = done.join(parents, done["conv"].eqNullSafe(parents["c"]) & (done["node"] == parents["u"]), "left_anti")
    order = Window.partitionBy("conv").orderBy(F.desc(F.col("score") / F.col("depth")), F.desc("depth"), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(order))
    if branches is not None:
        chosen = chosen.where(F.col("rank") <= branches)
    # cut at each level: the plan would double with every self-join
    path = cut(chosen.select("conv", F.col("node").alias("leaf"), "rank", "node", "depth", F.lit(0).cast("long").alias("above")))
    for i, level in enumerate(levels):
        l = level.select(F.col("conv").alias("c"), F.col("node").alias("n"), "up")
        higher = path.join(l, path["conv"].eqNullSafe(l["c"]) & (path["node"] == l["n"])).select("conv", "leaf", "rank", F.col("up").alias("node"), "depth", (F.col("above") + 2**i).alias("above"))
        path = cut(path.union(higher))
    return path.select("conv", "leaf", "rank", (F.col("depth") - 1 - F.col("above")).alias("position"), "node")


def format_paths(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """(conv, leaf, rank, n_turns, formatted) for messages with role and text."""
    paths = reply_paths(messages, branches)
    body = messages.select(F.col("conv").alias("c"), F.col("node").alias("n"), F.concat(F.lit(TURN), escaped(F.coalesce("role", F.lit(""))), F.lit(SAYS), escaped(F.coalesce("text", F.lit(""))), F.lit(END)).alias("turn"))
    turns = paths.join(body, paths["conv"].eqNullSafe(body["c"]) & (paths["node"] == body["n"]))
    rows = turns.groupBy("conv", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct("position", "turn"))).alias("turns"))
    return rows.select("conv", "leaf", "rank", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.col("turns.turn"), "").alias("formatted"))


def linear_messages(conversations: DataFrame) -> DataFrame:
    """Messages of plain conversations: each turn replies to the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", F.col("role"), F.col("text"))
    n = conversations.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    return n.select(F.col("conv_id").alias("conv"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def loss_mask(formatted: DataFrame, role: str = "assistant") -> DataFrame:
    """Read formatted conversations back: adds turns (role, text), and mask, the ranges of code points to learn."""

    def run(batches):
        for b in batches:
            turns, mask = [], []
            for f in b.column("formatted").to_pylist():
                own = parse(f)
                turns.append([{"role": r, "text": t} for r, t, _, _ in own])
                mask.append([{"start": s, "end": e} for r, _, s, e in own if r == role])
            yield b.append_column("turns", pa.array(turns, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))).append_column("mask", pa.array(mask, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))

    kinds = ", ".join(f"{c} {t}" for c, t in formatted.dtypes)
    return formatted.mapInArrow(run, f"{kinds}, turns array<struct<role:string,text:string>>, mask array<struct<start:long,end:long>>")


def digests(masked: DataFrame) -> DataFrame:
    """turns_sha256, loss_chars, loss_sha256 and formatted_chars of formatted conversations with their mask."""
    kind = dict(masked.dtypes)["conv"]

    def run(batches):
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
            for f, turns, mask in zip(*(b.column(c).to_pylist() for c in ("formatted", "turns", "mask"))):
                learnt = "".join(unescape(f[m["start"] : m["end"]]) for m in mask)
                out["turns_sha256"].append(hashlib.sha256("".join(f"{t['role']}\n{t['text']}\n" for t in turns).encode()).hexdigest())
                out["loss_chars"].append(len(learnt))
                out["loss_sha256"].append(hashlib.sha256(learnt.encode()).hexdigest())
                out["formatted_chars"].append(len(f))
            yield pa.RecordBatch.from_pydict({"conv_id": b.column("conv"), "n_turns": pa.array([len(t) for t in b.column("turns").to_pylist()], pa.int64()), **{c: pa.array(v, pa.string() if "sha" in c else pa.int64()) for c, v in out.items()}})

    return masked.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
