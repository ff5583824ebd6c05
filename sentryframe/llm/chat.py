"""Chat formatting from reply trees, in built-in functions only.

``reply_paths`` enumerates root-to-leaf paths by iterative self-joins.  Every round doubles the
reach: a leaf knows its ancestors up to 2^k steps away, and each message knows the ancestor
exactly 2^k steps away, so a thread of n messages takes log2(n) rounds and no join is keyed by
the thread.  Branches are ranked by the sum of their scores, then by leaf.  ``format_paths``
writes each chosen path as one conversation.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn.  In a text, every ``<``, any number of
backslashes, ``|`` gets one more backslash, so no control string can stand in a text, and taking
one backslash away reads it back.  In a role, backslash and newline are escaped as well.  The
result keeps the pieces it was joined from and the piece numbers under the loss mask: the texts
of assistant turns, each once.

Null text and null role are empty.  Messages with a null id can have no replies but are leaves
of their own; a null thread id is a thread.  A parent that does not exist makes its child a
root.  Repeated (thread, message) ids: the one with the smallest content is taken.  A cycle of
replies has no root and gives no path.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # An escaped role holds no newline, so a newline can stand for the doubled backslash.
    marked = F.replace(role, F.lit("\\\\"), F.lit("\n"))
    parts = F.transform(F.split(marked, "\n"), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return unescape(F.concat_ws("\\", parts))


def reply_paths(
    messages: DataFrame, *, thread: str = "thread_id", message: str = "message_id",
    parent: str = "parent_id", role: str = "role", text: str = "text", score: str | None = None,
    best: int | None = None,
) -> DataFrame:
    """``thread, leaf, rank, pos, role, text``: the turns of each root-to-leaf path.

    ``rank`` 1 is the thread's best branch; ``best`` keeps that many branches of a thread.
    """
    value = F.coalesce(F.col(f"`{score}`").cast("double"), F.lit(0.0)) if score else F.lit(0.0)
    rows = messages.select(
        F.col(f"`{thread}`").alias("thread"), F.col(f"`{message}`").alias("msg"), F.col(f"`{parent}`").alias("up"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
        value.alias("score"),
    )
    # The smallest content of a repeated id; node numbers a message by its thread and id.
    nodes = rows.groupBy("thread", "msg").agg(F.min(F.struct("up", "role", "text", "score")).alias("m"))
    nodes = cut(nodes.select("thread", "msg", "m.*"))
    ids = nodes.select("thread", "msg")
    links = nodes.where("up is not null").select("thread", "msg", "up")
    held = ids.select(F.col("thread").alias("t"), F.col("msg").alias("u"))
    # jump: message -> ancestor exactly 2^k steps up.
    jump = links.join(held, F.col("thread").eqNullSafe(F.col("t")) & (F.col("up") == F.col("u"))).select(
        "thread", "msg", F.col("up").alias("far"))
    rooted = nodes.join(
        jump.select(F.col("thread").alias("t"), F.col("msg").alias("m"), F.lit(1).alias("child")),
        F.col("thread").eqNullSafe(F.col("t")) & F.col("msg").eqNullSafe(F.col("m")), "left",
    ).select(F.col("thread").alias("t"), F.col("msg").alias("m"), "role", "text", "score", F.col("child").isNull().alias("root"))
    parents = jump.select(F.col("thread").alias("t"), F.col("far").alias("u")).distinct()
    leaves = ids.join(parents, F.col("thread").eqNullSafe(F.col("t")) & F.col("msg").eqNullSafe(F.col("u")), "left_anti")
    member = leaves.select("thread", F.col("msg").alias("leaf"), "msg", F.lit(0).cast("long").alias("up_by"))
    jump = cut(jump)
    reach, most = 1, jump.groupBy("thread").count().agg(F.max("count")).first()[0] or 0
    while reach <= most and not jump.isEmpty():
        step = jump.select(F.col("thread").alias("t"), F.col("msg").alias("m"), "far")
        further = member.join(step, F.col("thread").eqNullSafe(F.col("t")) & F.col("msg").eqNullSafe(F.col("m"))).select(
            "thread", "leaf", F.col("far").alias("msg"), (F.col("up_by") + reach).alias("up_by"))
        member = cut(member.unionByName(further))
        jump = cut(jump.join(step.withColumnRenamed("far", "farther"),
                             F.col("thread").eqNullSafe(F.col("t")) & (F.col("far") == F.col("m")))
                   .select("thread", "msg", F.col("farther").alias("far")))
        reach *= 2
    turns = member.join(
        rooted,
        F.col("thread").eqNullSafe(F.col("t")) & F.col("msg").eqNullSafe(F.col("m")),
    ).select("thread", "leaf", (-F.col("up_by")).alias("pos"), "role", "text", "score", "root")
    ranks = turns.groupBy("thread", "leaf").agg(F.sum("score").alias("total"), F.max("root").alias("root")).where("root").select(
        F.col("thread").alias("t"), F.col("leaf").alias("l"),
        F.row_number().over(W.partitionBy("thread").orderBy(F.col("total").desc(), F.col("leaf").asc_nulls_last())).alias("rank"))
    if best is not None:
        ranks = ranks.where(F.col("rank") <= best)
    return turns.join(ranks, F.col("thread").eqNullSafe(F.col("t")) & F.col("leaf").eqNullSafe(F.col("l"))).select(
        "thread", "leaf", "rank", "pos", "role", "text")


def format_paths(turns: DataFrame, *, loss_role: str = LOSS_ROLE) -> DataFrame:
    """``thread, leaf, rank, formatted, pieces, loss_pieces``: one row per path.

    ``formatted`` is the pieces joined; ``loss_pieces`` numbers (from 0) those under the mask.
    Ordering happens inside the row: a path is one conversation and must come together there.
    """
    made = turns.groupBy("thread", "leaf", "rank").agg(
        F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("turns"))
    pieces = F.flatten(F.transform("turns", lambda t: F.array(
        F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")), escape(t["text"]), F.lit(END + "\n"))))
    marks = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == loss_role, 3 * i + 1)), lambda x: x.isNotNull())
    return made.select(
        "thread", "leaf", "rank", pieces.alias("pieces"), marks.alias("loss_pieces"),
    ).withColumn("formatted", F.concat_ws("", "pieces"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of ``role, text``."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda b, i: i > 0)

    def turn(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        body = F.replace(F.substr(block, F.length(role) + 2), F.lit(END + "\n"), F.lit(""))
        return F.struct(unescape_role(role).alias("role"), unescape(body).alias("text"))

    return F.transform(blocks, turn)


def read_loss(pieces: Column, marks: Column) -> Column:
    """All text under the loss mask, read back."""
    return F.concat_ws("", F.transform(marks, lambda i: unescape(F.get(pieces, i))))


def from_turns(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """A plain turn table as reply trees: each row answers the row before it.

    Rows of one conversation with the same turn follow each other by role and text; nulls come first.
    """
    order = W.partitionBy("conv").orderBy(
        F.col("at").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    picked = rows.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("at"), "role", "text")
    return picked.select(
        F.col("conv").alias("thread_id"), F.row_number().over(order).alias("message_id"), "role", "text",
    ).withColumn("parent_id", F.when(F.col("message_id") > 1, F.col("message_id") - 1))
