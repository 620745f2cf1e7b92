"""First-fit grouping: the rule shared by box suppression and cluster collapse.

Rows of a group are visited in order. A row joins the earliest leader that covers it, otherwise it
becomes a leader itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.session import cut_lineage

Covers = Callable[[Column, Column], Column]


def _fold(rows: DataFrame, keys: list[str], covers: Covers, leaders_only: bool) -> DataFrame:
    """The rule over whole groups, as a fold on a sorted array."""
    first = ["_rank", "det_id"]
    item = F.struct(*first, *[c for c in rows.columns if c not in [*keys, *first]])
    grouped = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("_items"))
    none = F.slice("_items", 1, 0)
    leaders = F.aggregate(
        "_items", none,
        lambda kept, x: F.when(F.exists(kept, lambda k: covers(k, x)), kept).otherwise(F.concat(kept, F.array(x))),
    )
    if leaders_only:
        return grouped.select(*keys, F.explode(leaders).alias("_x")).select(
            *keys, "_x.*", F.col("_x.det_id").alias("leader_id")
        )
    return (
        grouped.withColumn("_leaders", leaders)
        .select(*keys, "_leaders", F.explode("_items").alias("_x"))
        .withColumn("leader_id", _leader(F.col("_leaders"), F.col("_x"), covers))
        .select(*keys, "_x.*", "leader_id")
    )


def _leader(leaders: Column, x: Column, covers: Covers) -> Column:
    """Own id for a leader, else the id of the first leader that covers ``x``."""
    own = F.exists(leaders, lambda k: k["det_id"] == x["det_id"])
    return F.when(own, x["det_id"]).otherwise(
        F.get(F.filter(leaders, lambda k: covers(k, x)), F.lit(0))["det_id"]
    )


def large_groups(boxes: DataFrame, keys: list[str], max_group: int = 5000) -> DataFrame:
    """The keys of groups of more than ``max_group`` rows."""
    return boxes.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > max_group).select(*keys)


def first_fit(
    boxes: DataFrame, keys: list[str], covers: Covers, needs: list[str], max_group: int = 5000,
    leaders_only: bool = False, salts: int = 64, bounded: bool = False,
) -> DataFrame:
    """Add ``leader_id`` to every row, or return only the leaders; a leader's id is its own ``det_id``.

    ``covers(leader, row)`` may use ``det_id`` and the columns ``needs`` of both.

    Order: confidence descending (missing counts as 0), then ``det_id``, which is unique in a group.
    Groups up to ``max_group`` rows are folded in one array. Larger ones are worked off in rounds: the
    first ``max_group`` open rows are folded, their leaders are sent to all salted parts of the group,
    and covered rows leave. Every open row comes after those leaders in order, so the result is the
    same as one long fold. ``bounded``: the caller knows that no group is larger, so none is counted.
    """
    ranked = boxes.withColumn("_rank", -F.coalesce("confidence", F.lit(0.0)))
    large = large_groups(ranked, keys, max_group)
    if bounded or large.isEmpty():
        return _fold(ranked, keys, covers, leaders_only).drop("_rank")

    large = cut_lineage(large)
    done = [_fold(ranked.join(large, keys, "left_anti"), keys, covers, leaders_only)]
    salt = F.pmod(F.xxhash64("det_id"), F.lit(salts)).cast("int")
    open_rows = cut_lineage(ranked.join(large, keys, "left_semi").withColumn("_salt", salt))
    columns = [c for c in open_rows.columns if c != "_salt"]
    in_order = Window.partitionBy(*keys).orderBy("_rank", "det_id")
    while not open_rows.isEmpty():
        # row_number <= n is cut on the map side, so a large group sends few rows to its task
        head = (
            open_rows.select(*columns).withColumn("_rn", F.row_number().over(in_order))
            .where(F.col("_rn") <= max_group).drop("_rn")
        )
        head = cut_lineage(_fold(head, keys, covers, False))
        done.append(head.where(F.col("leader_id") == F.col("det_id")) if leaders_only else head)
        per_group = head.groupBy(*keys).agg(
            F.sort_array(F.collect_list(F.when(
                F.col("leader_id") == F.col("det_id"), F.struct("_rank", "det_id", *needs)
            ))).alias("_leaders"),
            F.max(F.struct("_rank", "det_id")).alias("_last"),
        ).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        tail = open_rows.join(per_group, [*keys, "_salt"]).where(F.struct("_rank", "det_id") > F.col("_last"))
        x = F.struct(*needs)
        hit = F.get(F.filter("_leaders", lambda k: covers(k, x)), F.lit(0))["det_id"]
        judged = cut_lineage(tail.select(*columns, "_salt", hit.alias("leader_id")))
        if not leaders_only:
            done.append(judged.where(F.col("leader_id").isNotNull()).drop("_salt"))
        open_rows = judged.where(F.col("leader_id").isNull()).drop("leader_id")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.drop("_rank")
