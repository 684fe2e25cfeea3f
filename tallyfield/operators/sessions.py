"""Sessions of one key's events, separated by pauses.

Method: pointer doubling. Events are first folded into cells as long as the permitted pause, so all events of
one key and cell belong together; each cell is linked to the cell before it where the step between them is
within the pause; the pointers are then doubled by self-joins until every cell points to the first cell of its
session. Every join and grouping is keyed by (key, cell), so a key with a third of all rows is spread over
all tasks and no task ever sorts or holds one key's events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable

MAX_ROUNDS = 64  # pointers double, so this covers chains of 2**64 cells


def sessions(events: DataFrame, key: str, at_us: str, gap_us: int, event_id: str | None = None) -> DataFrame:
    """Sessions as ``key, start_us, end_us, duration_us, events``.

    ``at_us`` is a whole number of microseconds; a step of exactly ``gap_us`` does not end a session.
    With ``event_id``, repeated deliveries of an id count once (their first instant counts if they differ).
    Rows with a null key or instant are left out; events at one instant share a session; an empty table gives
    an empty result. Other columns, whatever their names, are ignored.
    """
    if gap_us <= 0:
        raise ValueError("gap_us must be positive")
    e = events.select(
        F.col(key).alias("k"), F.col(at_us).cast("long").alias("t"),
        *([F.col(event_id).alias("i")] if event_id else []),
    ).where("k IS NOT NULL AND t IS NOT NULL")
    if event_id:
        named = e.where("i IS NOT NULL").groupBy("i").agg(F.min(F.struct("t", "k")).alias("e")).select("e.k", "e.t")
        e = named.unionByName(e.where("i IS NULL").select("k", "t"))
    t = F.col("t")
    cell = F.expr(f"t div {gap_us}") - F.when((t < 0) & (t % gap_us != 0), 1).otherwise(0)  # rounds down
    cells = durable(
        e.groupBy("k", cell.alias("c")).agg(
            F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count(F.lit(1)).alias("n")
        )
    )
    before = cells.select("k", (F.col("c") + 1).alias("c"), F.col("last_t").alias("before_t"))
    linked = durable(
        cells.join(before, ["k", "c"], "left").select(
            "k", "c", F.when(F.col("first_t") - F.col("before_t") <= gap_us, F.col("c") - 1).alias("p"),
        ).where("p IS NOT NULL")
    )
    roots = _roots(linked)
    return (
        cells.join(roots, ["k", "c"], "left")
        .groupBy("k", F.coalesce("root", "c").alias("root"))
        .agg(F.min("first_t").alias("start_us"), F.max("last_t").alias("end_us"), F.sum("n").alias("events"))
        .select(
            F.col("k").alias(key), "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"),
            "events",
        )
    )


def _roots(linked: DataFrame) -> DataFrame:
    """``k, c, root`` for every linked cell; a cell without a row in ``linked`` is a root itself.

    A pointer is settled once it leads to a root. Each round sends the open pointers one jump on, to where their
    target's pointer leads, so the distance covered doubles.
    """
    state = linked.select("k", "c", "p", F.lit(False).alias("settled"))
    for _ in range(MAX_ROUNDS):
        target = state.select("k", F.col("c").alias("p"), F.col("p").alias("q"), F.col("settled").alias("q_settled"))
        moved = (
            state.where("NOT settled").join(target, ["k", "p"], "left")
            .select("k", "c", F.coalesce("q", "p").alias("p"), F.coalesce("q_settled", F.lit(True)).alias("settled"))
        )
        state = durable(state.where("settled").unionByName(moved))
        if state.where("NOT settled").isEmpty():
            break
    return state.select("k", "c", F.col("p").alias("root"))
