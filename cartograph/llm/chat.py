"""Chat formatting of reply trees with DataFrame functions only.

A tree node is a message with a parent. Paths from root to leaf are found by iterative self-joins
that double their reach: the table of ancestors at distance 1, 2, 4, ... is joined with itself
until no node has one, then each leaf is joined with those tables from the farthest to the
nearest, which meets each ancestor once. A chain of a thousand turns takes ten joins. Paths of a
conversation are ranked by the sum of their messages' scores, and each chosen one is formatted as
one conversation.

The format: for each turn ``<|im_start|>``, role, ``<|im_sep|>``, text, ``<|im_end|>`` and a line
feed. In roles and texts a backslash is doubled, and one is put after the first character of each
control string, so no text can close a turn, and reading back gives the very same text. The result
is a list of segments; their concatenation is the formatted text, and segments under the loss mask
are the texts of the assistant.

Cases: null texts and roles are empty; a null conversation id is a conversation; a parent that is
not in the conversation makes its child a root; repeated rows of a turn are turns of their own, in
order of role and text; an empty table gives an empty table; names of further columns are free.
Parents that form a ring are an error. One conversation becomes one cell, whatever its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartograph.session import stage

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
# Control strings of this template and of others that a trainer may know.
CONTROL = (START, SEPARATOR, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for word in CONTROL:
        text = F.replace(text, F.lit(word), F.lit(f"{word[0]}\\{word[1:]}"))
    return text


def unescape(text: Column) -> Column:
    """A doubled backslash is one, a single one was put there by :func:`escape`."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def turn_chain(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Tree nodes of conversations without branches: each turn replies to the one before it."""
    named = turns.select(
        turns[conv].alias("conv"),
        turns[turn].alias("turn"),
        F.coalesce(turns[role], F.lit("")).alias("role"),
        F.coalesce(turns[text], F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    node = F.row_number().over(order).cast("long")
    return named.select("conv", node.alias("node"), (node - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def _meet(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Join on conversation (null equals null) and ``left[on] = right.node``."""
    other = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns))
    return left.join(other, left["conv"].eqNullSafe(other["r_conv"]) & (left[on] == other["r_node"]))


def tree_paths(nodes: DataFrame) -> DataFrame:
    """(conv, leaf, node, distance): every node on the way from each leaf to its root.

    ``nodes``: conv, node, parent, score, role, text; ``node`` is unique in its conversation.
    """
    slim = nodes.select("conv", "node", "parent")
    known = stage(
        _meet(slim, slim.select("conv", "node"), "parent").select("conv", "node", "parent"), "parents"
    )
    size = nodes.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    up, levels = known.df.withColumnRenamed("parent", "above"), []
    rows = known.rows
    while rows:
        levels.append(up)
        if 1 << (len(levels) - 1) > size:
            raise ValueError("the parents of a conversation form a ring")
        farther = stage(
            _meet(up, up, "above").select("conv", "node", F.col("r_above").alias("above")), "ancestors"
        )
        up, rows = farther.df, farther.rows
    other = known.df.select(F.col("conv").alias("c"), F.col("parent").alias("p"))
    leaves = slim.join(
        other, slim["conv"].eqNullSafe(other["c"]) & (slim["node"] == other["p"]), "left_anti"
    )
    reached = leaves.select("conv", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("distance"))
    for k in reversed(range(len(levels))):
        farther = _meet(reached, levels[k], "node").select(
            "conv", "leaf", F.col("r_above").alias("node"), (F.col("distance") + (1 << k)).alias("distance")
        )
        reached = stage(reached.unionByName(farther), "paths").df
    return reached


def format_trees(nodes: DataFrame, branches: int | None = None) -> DataFrame:
    """(conv, leaf, rank, score, segments): each chosen path as one conversation.

    ``branches`` is the number of best paths of a conversation that are chosen; all if it is None.
    Ties go to the smaller leaf. ``segments`` is an array of (piece, loss).
    """
    nodes = stage(nodes, "nodes").df
    on_path = _meet(tree_paths(nodes), nodes, "node")

    def segment(piece: Column, loss: Column) -> Column:
        return F.struct(piece.alias("piece"), loss.alias("loss"))

    no = F.lit(False)
    turn = F.array(
        segment(F.concat(F.lit(START), escape(F.col("r_role")), F.lit(SEPARATOR)), no),
        segment(escape(F.col("r_text")), F.col("r_role") == TRAINED_ROLE),
        segment(F.lit(END + "\n"), no),
    )
    paths = on_path.groupBy("conv", "leaf").agg(
        F.sum("r_score").alias("score"),
        F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("place"), turn.alias("turn")))).alias("turns"),
    )
    if branches is not None:
        order = Window.partitionBy("conv").orderBy(F.desc("score"), "leaf")
        slim = paths.select("conv", "leaf", "score").withColumn("rank", F.row_number().over(order))
        chosen = slim.where(F.col("rank") <= branches).drop("score").select(
            F.col("conv").alias("c"), F.col("leaf").alias("l"), "rank"
        )
        paths = paths.join(chosen, paths["conv"].eqNullSafe(chosen["c"]) & (paths["leaf"] == chosen["l"]))
    else:
        paths = paths.withColumn("rank", F.lit(None).cast("int"))
    return paths.select("conv", "leaf", "rank", "score", F.flatten("turns.turn").alias("segments"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv, leaf, turns, loss_text, formatted): what the formatted text and the mask say.

    ``turns`` is an array of (role, text), parsed from the concatenated text alone.
    """
    text = F.array_join(F.col("segments.piece"), "")
    loss = F.array_join(
        F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["piece"])), ""
    )

    def parse(part: Column) -> Column:
        role = F.substring_index(part, SEPARATOR, 1)
        rest = F.substring_index(part, SEPARATOR, -1)
        return F.struct(
            unescape(role).alias("role"), unescape(F.substring_index(rest, END, 1)).alias("text")
        )

    parts = F.split(F.col("formatted"), r"<\|im_start\|>")
    return formatted.select("conv", "leaf", text.alias("formatted"), loss.alias("loss_text")).select(
        "*", F.transform(F.slice(parts, 2, F.size(parts) - 1), parse).alias("turns")
    )
