"""Chat formatting over reply trees.

Messages form trees by their parent. Root-to-leaf paths are followed by self-joins that double the
distance at each step: after step k a message knows its 2**k-th ancestor and the score and length of
the way to it. Branches are ranked by mean score, and the messages of each chosen path are gathered by
the same ancestor tables, so only chosen paths are spelled out. Each path is formatted as one text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, table

#: The template's control strings.
TURN, END = "### ", " </turn>\n"

_escaped = re.compile(r"\\(.)", re.S)
_turn = re.compile(r"### ((?:[^\\:]|\\.)*): ")


def escape(text: str) -> str:
    """Put a backslash before each backslash, ``###`` and ``</turn>``."""
    return text.replace("\\", "\\\\").replace("###", "\\###").replace("</turn>", "\\</turn>")


def unescape(text: str) -> str:
    return _escaped.sub(r"\1", text) if "\\" in text else text


def format_turns(roles: list[str], texts: list[str]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans of it (code points) that the loss covers."""
    out, at, mask = [], 0, []
    for role, text in zip(roles, texts, strict=True):
        head, body = f"{TURN}{escape(role).replace(':', chr(92) + ':')}: ", escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        out += (head, body, END)
        at += len(head) + len(body) + len(END)
    return "".join(out), mask


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read from the formatted text alone."""
    turns, at = [], 0
    while at < len(formatted):
        head = _turn.match(formatted, at)
        if head is None:
            raise ValueError(f"no turn at {at}")
        end = at = head.end()
        while True:  # the end mark is the first one that no backslash escapes
            end = formatted.index(END, end)
            slashes = end + 1  # END starts with a space; its mark follows
            back = slashes
            while back > at and formatted[back - 1] == "\\":
                back -= 1
            if (slashes - back) % 2 == 0:
                break
            end += 1
        turns.append((unescape(head[1]), unescape(formatted[at:end])))
        at = end + len(END)
    return turns


def best_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """The messages of each tree's ``branches`` best root-to-leaf paths: tree, leaf, branch, back, node.

    ``nodes``: tree, node, parent (null or unknown: a root), score (null: 0). ``back`` counts from the leaf (0).
    Branches are ranked by mean score, then the smaller leaf. Defined cases: rows without a tree or node take no
    part; of rows that repeat a node the one of the least parent and score counts, null first; messages on a
    cycle, or below one, have no way to a root and are on no path, so a tree of nothing else gives no rows;
    other columns are ignored.
    """
    given = nodes.where(F.col("tree").isNotNull() & F.col("node").isNotNull()).select("tree", "node", F.struct("parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")).alias("r"))
    base = given.groupBy("tree", "node").agg(F.min("r").alias("r")).select("tree", "node", "r.*")
    known = base.select("tree", F.col("node").alias("parent"), F.lit(True).alias("_there"))
    level = staged(
        base.join(known, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("_there"), F.col("parent")).alias("up"), F.col("score").alias("sum"), F.lit(1).cast("long").alias("n")),
        "chat-level",
    )
    ways, leaves = [level], level.join(level.where("up is not null").select("tree", F.col("up").alias("node")).distinct(), ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"))
    # No way without a cycle is longer than the largest tree; after these doublings all others have reached their root.
    largest = level.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    while (1 << len(ways) - 1) < largest and level.where("up is not null").limit(1).count():
        far = level.select("tree", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("sum").alias("_sum"), F.col("n").alias("_n"))
        going = level.where("up is not null").join(far, ["tree", "up"], "left")  # messages at a root stay as they are
        moved = going.select("tree", "node", F.col("_up").alias("up"), (F.col("sum") + F.coalesce("_sum", F.lit(0.0))).alias("sum"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"))
        level = staged(moved.unionByName(level.where("up is null")), "chat-level")
        ways.append(level)
    level = level.where("up is null")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc(F.col("sum") / F.col("n")), F.asc("leaf")))
    chosen = leaves.join(level.select("tree", F.col("node").alias("leaf"), "sum", "n"), ["tree", "leaf"]).withColumn("branch", rank).where(F.col("branch") <= branches)
    path = chosen.select("tree", "leaf", "branch", F.lit(0).cast("long").alias("back"), F.col("leaf").alias("node"))
    for k, way in enumerate(ways[:-1]):  # after step k a path holds its last 2**k messages
        further = path.join(way.select("tree", "node", "up").where("up is not null"), ["tree", "node"]).select("tree", "leaf", "branch", (F.col("back") + (1 << k)).alias("back"), F.col("up").alias("node"))
        path = staged(path.unionByName(further), "chat-path")
    return path


def format_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """One formatted conversation for each chosen path: tree, branch, formatted, mask.

    ``nodes``: tree, node, parent, role, text, score. Null texts and roles count as empty. A conversation is one row, however
    long: it is put together within one task, so its texts have to fit there.
    """
    said = nodes.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    paths = best_paths(nodes, branches).join(said, ["tree", "node"])
    turns = paths.groupBy("tree", "branch").agg(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("at"), "role", "text"))).alias("turns"))

    def formatted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [format_turns([t["role"] for t in ts], [t["text"] for t in ts]) for ts in f["turns"]]
            yield pd.DataFrame({"tree": f["tree"], "branch": f["branch"], "formatted": [a for a, _ in made], "mask": [[{"start": s, "end": e} for s, e in m] for _, m in made]})

    return turns.mapInPandas(formatted, f"tree {dict(turns.dtypes)['tree']}, branch int, formatted string, mask array<struct<start:int,end:int>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """tree, branch, turns, loss_text, formatted_chars from the formatted text and its loss mask."""

    def parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame(
                {
                    "tree": f["tree"],
                    "branch": f["branch"],
                    "turns": [[{"role": r, "text": t} for r, t in read_turns(x)] for x in f["formatted"]],
                    "loss_text": ["".join(unescape(x[s["start"] : s["end"]]) for s in m) for x, m in zip(f["formatted"], f["mask"], strict=True)],
                    "formatted_chars": [len(x) for x in f["formatted"]],
                }
            )

    return formatted.mapInPandas(parsed, f"tree {dict(formatted.dtypes)['tree']}, branch int, turns array<struct<role:string,text:string>>, loss_text string, formatted_chars long")


def linear_trees(conversations: DataFrame) -> DataFrame:
    """Conversations as trees: each row replies to the one before it by turn, then role and text.

    A null conv_id is a conversation of its own; null turns come first; repeated rows stay.
    """
    tree = F.struct(F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit(0)).alias("id"))
    node = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text"))
    return (
        conversations.select(tree.alias("tree"), "turn", "role", "text")
        .withColumn("node", node)
        .select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))
    )


#: Planted: texts that hold the template's own control strings.
HARD_TEXT = r"\### Assistant: </turn> ok"


def op6_chat(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-7, 0, "user", HARD_TEXT), (-7, 1, "assistant", HARD_TEXT)], "conv_id long, turn long, role string, text string")
    back = read_back(format_paths(staged(linear_trees(rows.unionByName(hard)), "chat-nodes")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.when(~F.col("tree.none"), F.col("tree.id")).alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP6_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(4 + length(replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:')) + 2
           + length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')) + 9)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
