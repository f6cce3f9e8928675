"""The depth-first order of a folder tree, from each folder's parent and its place among its siblings.

The walk around the tree enters and leaves each folder once. The next step of each step follows from the edges alone: into
the first child, on to the next sibling, or back to the parent. How much lies behind each step is found by pointer
jumping: in each round every step adds what its target knows and points where its target pointed, so that a path of n
folders takes as many rounds as n has binary digits, like any other tree.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.operators.numbering import numbered
from postmill.session import written

# Sibling ranks per piece when siblings are numbered.
BLOCK = 4096
SUMS = ("entered", "held", "deeper")


def steps(folders: DataFrame) -> DataFrame:
    """(folder, out, next_folder, next_out, entered, held, deeper): the walk's two steps per folder, each with the next one.

    ``folders`` has folder, parent, place (a long that orders siblings; equal ones are ordered by folder) and messages.
    entered, held and deeper are what the step adds: a folder, its messages, and one level down or up.
    """
    known = folders.select(F.col("folder").alias("parent"))
    tops = folders.join(known, "parent", "left_anti").withColumn("parent", F.lit(None).cast(folders.schema["folder"].dataType))
    rows = folders.join(known, "parent", "left_semi").unionByName(tops).select(
        "folder", "parent", F.col("parent").isNull().alias("top"), "place", "messages")
    # Top folders are siblings of each other under a parent that is no folder.
    keyed = rows.withColumn("_parent", F.coalesce(F.concat(F.lit("f"), F.col("parent").cast("string")), F.lit("")))
    ordered = written(numbered(keyed, ["_parent"], [F.col("place"), F.col("folder")], [F.expr(f"place div {BLOCK}")], "_nth"), "siblings")
    before = ordered.select("_parent", (F.col("_nth") - 1).alias("_nth"), F.col("folder").alias("sibling"))
    first = ordered.filter("_nth = 0 AND NOT top").select(F.col("parent").alias("folder"), F.col("folder").alias("child"))
    both = ordered.join(before, ["_parent", "_nth"], "left").join(first, "folder", "left")
    enter = both.select("folder", F.lit(False).alias("out"), F.coalesce("child", "folder").alias("next_folder"),
                        F.col("child").isNull().alias("next_out"), F.lit(1).cast("long").alias("entered"),
                        F.col("messages").cast("long").alias("held"), F.lit(1).cast("long").alias("deeper"))
    leave = both.select("folder", F.lit(True).alias("out"), F.coalesce("sibling", "parent").alias("next_folder"),
                        F.col("sibling").isNull().alias("next_out"), F.lit(0).cast("long").alias("entered"),
                        F.lit(0).cast("long").alias("held"), F.lit(-1).cast("long").alias("deeper"))
    return enter.unionByName(leave)


def ranked(walk: DataFrame) -> DataFrame:
    """The steps with the sums of all steps from each to the end of the walk; steps that never end there raise."""
    now = written(walk, "steps")
    rounds = max(1, math.ceil(math.log2(max(now.count(), 2)))) + 1
    for _ in range(rounds):
        # Steps that point at the end wait; the others ask their target.
        asking = now.filter(F.col("next_folder").isNotNull())
        if asking.isEmpty():
            return now
        target = now.select(F.col("folder").alias("next_folder"), F.col("out").alias("next_out"), F.col("next_folder").alias("_folder"),
                            F.col("next_out").alias("_out"), *(F.col(s).alias(f"_{s}") for s in SUMS))
        moved = asking.join(target, ["next_folder", "next_out"]).select(
            "folder", "out", F.col("_folder").alias("next_folder"), F.col("_out").alias("next_out"),
            *((F.col(s) + F.col(f"_{s}")).alias(s) for s in SUMS))
        now = written(moved.unionByName(now.filter(F.col("next_folder").isNull())), "jumped")
    if not now.filter(F.col("next_folder").isNotNull()).isEmpty():
        raise ValueError("folders form a cycle")
    return now


def tree_order(folders: DataFrame) -> DataFrame:
    """(folder, preorder, depth, subtree_size, first_index, subtree_messages) per row of ``folders``.

    ``folders`` has folder, parent, place and messages. preorder counts folders as a depth-first visit meets them, each
    before its subfolders and those by place; first_index is the number of messages met before the folder's own, and
    subtree_messages those of it and all below. Folders without a parent, or whose parent is no folder, are top folders in
    the order of their places. Null counts are no messages. A folder that is listed twice, or below itself, raises.
    """
    rows = written(folders.select("folder", "parent", F.coalesce(F.col("place").cast("long"), F.lit(0)).alias("place"),
                                  F.coalesce("messages", F.lit(0)).alias("messages")), "folders")
    if not rows.groupBy("folder").count().filter("count > 1 OR folder IS NULL").isEmpty():
        raise ValueError("folders must be told apart by a name each")
    walk = ranked(steps(rows))
    entered, left = (walk.filter(c).select("folder", *(F.col(s).alias(f"{s}_{n}") for s in SUMS)) for c, n in (("NOT out", "in"), ("out", "after")))
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("messages"), F.lit(0)).alias("m")).first()
    return entered.join(left, "folder").select(
        "folder", (F.lit(total["n"]) - F.col("entered_in")).alias("preorder"), (-F.col("deeper_in")).alias("depth"),
        (F.col("entered_in") - F.col("entered_after")).alias("subtree_size"), (F.lit(total["m"]) - F.col("held_in")).alias("first_index"),
        (F.col("held_in") - F.col("held_after")).alias("subtree_messages"))


def scan_index(messages: DataFrame, order: DataFrame, block: int = 1 << 16) -> DataFrame:
    """``messages`` (folder, pos and more) with ``scan_index``, the place in the depth-first visit of all folders.

    ``order`` comes from ``tree_order`` over the folders' numbers of these messages.
    """
    placed = numbered(messages, ["folder"], [F.col("pos")], [F.expr(f"pos div {block}")], "_within")
    return placed.join(order.select("folder", "first_index"), "folder").withColumn(
        "scan_index", F.col("first_index") + F.col("_within")).drop("_within", "first_index")
