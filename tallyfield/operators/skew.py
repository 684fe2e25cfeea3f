"""Per-key results where a few keys hold most rows.

Method: fragment and replicate by estimated load. Rows are first combined to one for each key, member and value
(with map-side combine, so no pair can be hot); the load of a key is the number of these. Keys above a fair
share are cut into shards in proportion to their load; these shards and the next largest keys are
bin-packed on to tasks, largest first into the emptiest; the long tail goes to tasks by hash. Rows follow their
key's shard, the matching side is copied only to the shards of the keys it belongs to, and each task aggregates
what it holds. Shards are cut by a second column (such as the volunteer), so distinct counts of that column add
up over shards.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable, parallelism

PLAN_SCHEMA = "key_field string, key_value long, tasks array<int>"
#: A key is cut when its load is over 1/SPLIT of a task's fair share, and placed by bin-packing when over 1/PACK.
#: The plan therefore has at most PACK keys for each task, whatever the number of keys.
SPLIT, PACK = 2, 32


def shard_plan(loads: DataFrame, tasks: int) -> list[tuple[str, int | None, list[int]]]:
    """(key_field, key_value, tasks of its shards) for the keys worth placing; at most PACK * tasks of them.

    An empty table gives an empty plan.
    """
    total = loads.agg(F.sum("load")).first()[0] or 0
    if not total:
        return []
    fair = total / tasks
    placed = loads.where(F.col("load") > fair / PACK).collect()
    pieces = []
    for r in placed:
        shards = max(1, math.ceil(r["load"] / (fair / SPLIT)))
        pieces += [(r["load"] / shards, r["key_field"], r["key_value"], n) for n in range(shards)]
    light = (total - sum(r["load"] for r in placed)) / tasks
    bins = [(light, t) for t in range(tasks)]
    where: dict[tuple[str, int | None], list[int]] = {}
    for load, field, value, _ in sorted(pieces, key=lambda p: (-p[0], p[1], _order(p[2]), p[3])):
        least, t = heapq.heappop(bins)
        heapq.heappush(bins, (least + load, t))
        where.setdefault((field, value), []).append(t)
    return [(f, v, t) for (f, v), t in sorted(where.items(), key=lambda x: (x[0][0], _order(x[0][1])))]


def _order(value: int | None) -> tuple[bool, int]:
    """Null keys come last."""
    return value is None, value or 0


def _planned(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with the ``tasks`` of their key, where the plan has it; the null key is a key like any other.

    ``plan`` has at most PACK rows for each task, which bounds the broadcast.
    """
    p = plan.toDF("_field", "_value_of", "tasks")
    same = (rows["key_field"] == p["_field"]) & rows["key_value"].eqNullSafe(p["_value_of"])
    return rows.join(F.broadcast(p), same, "left").drop("_field", "_value_of")


def assign(rows: DataFrame, plan: DataFrame, tasks: int, spread: Column) -> DataFrame:
    """Adds ``_task``: the shard's task for placed keys (shard by hash of ``spread``), else a task by hash of the key."""
    by_hash = F.pmod(F.xxhash64("key_field", "key_value"), F.lit(tasks)).cast("int")
    shard = F.pmod(F.xxhash64(spread), F.size("tasks")).cast("int")
    joined = _planned(rows, plan)
    return joined.withColumn("_task", F.when(F.col("tasks").isNull(), by_hash).otherwise(F.get("tasks", shard))).drop("tasks")


def replicate(side: DataFrame, plan: DataFrame, tasks: int) -> DataFrame:
    """``side`` (one row for each key) with ``_task``, once for each task that holds a shard of its key."""
    by_hash = F.array(F.pmod(F.xxhash64("key_field", "key_value"), F.lit(tasks)).cast("int"))
    joined = _planned(side, plan)
    return joined.withColumn("_task", F.explode(F.array_distinct(F.coalesce("tasks", by_hash)))).drop("tasks")


def per_key_results(
    rows: DataFrame, side: DataFrame | None = None, member: str = "user_key", value: str | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """One row for each key: ``key_field, key_value, rows, members[, values], <columns of side>``.

    ``rows`` has ``key_field, key_value`` and ``member``; ``rows`` counts all rows, ``members`` the distinct
    non-null members, ``values`` maps each non-null ``value`` to its rows (for values of few kinds, such as the answers
    to a question; a key's kinds make one row). ``side`` has one row for each key and
    is joined from the left. Rows with a null key form one key of their own; repeated rows count each time;
    an empty table gives an empty result. Columns of other names are ignored.
    """
    tasks = tasks or parallelism(rows.sparkSession)
    keys = ["key_field", "key_value"]
    base = rows.select(
        "key_field", F.col("key_value").cast("long").alias("key_value"), F.col(member).alias("_member"),
        *([F.col(value).cast("string").alias("_value")] if value else []),
    )
    # combined before it is shuffled: a member with very many rows of one key is one row from here on
    tuples = durable(base.groupBy(*base.columns).agg(F.count(F.lit(1)).alias("n")))
    loads = tuples.groupBy(*keys).agg(F.count(F.lit(1)).alias("load"))
    plan = rows.sparkSession.createDataFrame(shard_plan(loads, tasks), PLAN_SCHEMA)
    placed = assign(tuples, plan, tasks, F.col("_member")).repartitionById(tasks, F.col("_task"))
    parts = placed.groupBy("_task", *keys).agg(F.sum("n").alias("n"), F.count_distinct("_member").alias("m"))
    extra = []
    if side is not None:
        extra = [c for c in side.columns if c not in keys]
        copies = replicate(side, plan, tasks).repartitionById(tasks, F.col("_task"))
        parts = parts.join(copies, ["_task", *keys], "left")
    # a null never equals itself in a join, so the row of the null key simply has no side
    out = parts.groupBy("key_field", "key_value").agg(
        F.sum("n").alias("rows"), F.sum("m").alias("members"), *(F.first(c, ignorenulls=True).alias(c) for c in extra)
    )
    if value:
        tally = (
            tuples.where("_value IS NOT NULL").groupBy("key_field", "key_value", "_value").agg(F.sum("n").alias("n"))
            .groupBy("key_field", "key_value").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_value", "n")))).alias("values"))
        )
        same = out["key_field"].eqNullSafe(tally["key_field"]) & out["key_value"].eqNullSafe(tally["key_value"])
        out = out.join(tally, same, "left").select(out["*"], tally["values"])
    return out
