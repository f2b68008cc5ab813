"""Chat formatting of reply trees, in DataFrame operations only.

Messages point at the message they answer. Self-joins that double their reach find, for
every message, its distance from the root and the score of the path to it, and then list
the messages of each chosen root-to-leaf path; only ids travel in these rounds. The best
paths of a conversation are formatted, each as one training text.

Template: ``<s>[ROLE]role[/ROLE]text</s>`` for each turn. Inside roles and texts a
backslash follows every ``<``, ``[`` and backslash, so no control string can occur
there; dropping those backslashes restores the text.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from baitline.llm.tables import written

OPEN, ROLE_END, CLOSE = "<s>[ROLE]", "[/ROLE]", "</s>"
#: Turns of a conversation are numbered in stretches of so many turn values.
TURN_STRETCH = 256
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\[<\\])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\[<\\])\\", "$1")


def linear_messages(turns: DataFrame) -> DataFrame:
    """Messages of plain conversations: each turn answers the one before it.

    Rows of a conversation are ordered by turn, then role and text; nulls come first and
    every row counts, repeated ones too. Positions come from counts per stretch of turns,
    so a very long conversation is not numbered in one task.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("stretch", F.coalesce(F.floor(F.col("turn") / TURN_STRETCH), F.lit(-(2**62))))
    stretches = rows.groupBy("conv_id", "stretch").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    first = stretches.select(
        F.col("conv_id").alias("of"), F.col("stretch").alias("in"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"),
    )
    within = Window.partitionBy("conv_id", "stretch").orderBy("turn", "role", "text")
    numbered = rows.withColumn("place", F.row_number().over(within))
    at = numbered.join(first, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("stretch") == F.col("in")))
    position = F.col("first") + F.col("place") - 1
    return at.select(
        "conv_id", position.alias("node_id"), F.when(position > 0, position - 1).alias("parent_id"), "role", "text",
        F.lit(0.0).alias("score"),
    )


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def _jumps(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Each message with depth and path score, and the tables of jumps over 1, 2, 4, ... messages.

    A message whose chain of parents runs in a circle, or to a parent that is not there,
    has no root and no depth.
    """
    nodes = messages.select("conv_id", "node_id", "parent_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = nodes.select(F.col("conv_id").alias("c"), F.col("node_id").alias("n"))
    up = nodes.join(known, _same("conv_id", "c") & (F.col("parent_id") == F.col("n")), "left").select(
        "conv_id", "node_id", F.col("n").alias("up"), F.lit(1).cast("long").alias("steps"), "score",
        (F.col("parent_id").isNull()).alias("rooted"),
    )
    state = written(up, "chat-jumps")
    jumps = [state.filter("up IS NOT NULL").select("conv_id", "node_id", "up")]
    rounds, limit = 0, max(1, state.count()).bit_length() + 1
    while rounds < limit and not state.filter("up IS NOT NULL").isEmpty():
        other = state.select(
            F.col("conv_id").alias("c"), F.col("node_id").alias("n"), F.col("up").alias("up2"),
            F.col("steps").alias("steps2"), F.col("score").alias("score2"), F.col("rooted").alias("rooted2"),
        )
        further = state.filter("up IS NOT NULL").join(other, _same("conv_id", "c") & (F.col("up") == F.col("n"))).select(
            "conv_id", "node_id", F.col("up2").alias("up"), (F.col("steps") + F.col("steps2")).alias("steps"),
            (F.col("score") + F.col("score2")).alias("score"), F.col("rooted2").alias("rooted"),
        )
        state = written(state.filter("up IS NULL").unionByName(further), "chat-jumps")
        jumps.append(state.filter("up IS NOT NULL").select("conv_id", "node_id", "up"))
        rounds += 1
    depths = state.filter(F.col("up").isNull() & F.col("rooted")).select(
        "conv_id", "node_id", F.col("steps").alias("n_turns"), "score",
    )
    return depths, jumps


def ranked_paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """Rows (conv_id, leaf_id, branch, path_score, node_id, position) of the best paths.

    A path's score is the sum of its messages' scores (null: 0); branch 1 is the highest,
    ties go to the smaller leaf id. node_id must be unique within a conversation.
    """
    depths, jumps = _jumps(messages)
    parents = messages.select(F.col("conv_id").alias("c"), F.col("parent_id").alias("p")).filter("p IS NOT NULL").distinct()
    leaves = depths.join(parents, _same("conv_id", "c") & (F.col("node_id") == F.col("p")), "left_anti")
    order = Window.partitionBy("conv_id").orderBy(F.desc("score"), "node_id")
    chosen = leaves.withColumn("branch", F.row_number().over(order)).filter(F.col("branch") <= best)
    path = chosen.select(
        "conv_id", F.col("node_id").alias("leaf_id"), "branch", F.col("score").alias("path_score"), "node_id",
        (F.col("n_turns") - 1).alias("position"),
    )
    for k, jump in enumerate(jumps):
        hop = jump.select(F.col("conv_id").alias("c"), F.col("node_id").alias("n"), "up")
        further = path.filter(F.col("position") >= 2**k).join(hop, _same("conv_id", "c") & (F.col("node_id") == F.col("n"))).select(
            "conv_id", "leaf_id", "branch", "path_score", F.col("up").alias("node_id"),
            (F.col("position") - 2**k).alias("position"),
        )
        path = path.unionByName(further)
        if k % 2:
            path = written(path, "chat-paths")
    return path


def format_paths(messages: DataFrame, best: int = 1, loss_role: str = LOSS_ROLE) -> DataFrame:
    """Format the best paths of every conversation.

    Takes (conv_id, node_id, parent_id, role, text, score); other columns are left out.
    Returns conv_id, leaf_id, branch, path_score, n_turns, formatted and loss_spans, the
    code point ranges [start, end) of ``formatted`` that hold escaped texts of ``loss_role``.
    Null roles and texts count as empty. Empty input gives no rows. One conversation's
    text is one value, so it must fit a task.
    """
    path = ranked_paths(messages, best)
    bodies = messages.select(
        F.col("conv_id").alias("c"), F.col("node_id").alias("n"), F.coalesce("role", F.lit("")).alias("role"),
        escape(F.coalesce("text", F.lit(""))).alias("body"),
    )
    turns = path.join(bodies, _same("conv_id", "c") & (F.col("node_id") == F.col("n"))).select(
        "conv_id", "leaf_id", "branch", "path_score", "position", "role", "body",
        F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(ROLE_END), F.col("body"), F.lit(CLOSE)).alias("piece"),
    )
    upto = Window.partitionBy("conv_id", "leaf_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("piece").cast("long")).over(upto) - len(CLOSE)
    spans = turns.withColumn("end", end).withColumn(
        "span", F.when(
            F.col("role") == loss_role, F.struct((F.col("end") - F.length("body")).alias("start"), F.col("end").alias("end")),
        ),
    )
    grouped = spans.groupBy("conv_id", "leaf_id").agg(
        F.first("branch").alias("branch"), F.first("path_score").alias("path_score"),
        F.sort_array(F.collect_list(F.struct("position", "piece", "span"))).alias("turns"),
    )
    return grouped.select(
        "conv_id", "leaf_id", "branch", "path_score", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.col("turns.piece"), "").alias("formatted"),
        F.filter(F.col("turns.span"), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def parse_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted text."""
    pieces = F.filter(F.split(formatted, CLOSE, -1), lambda p: p != "")

    def turn(piece: Column) -> Column:
        cut = F.instr(piece, ROLE_END)
        return F.struct(
            unescape(F.substring(piece, F.lit(len(OPEN) + 1), cut - (len(OPEN) + 1))).alias("role"),
            unescape(F.substring(piece, cut + len(ROLE_END), F.length(piece))).alias("text"),
        )

    return F.transform(pieces, turn)


def masked_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "",
    )


