"""Sessions and the per-user listening clock.

Plays that share a time slot no wider than the session gap always belong to one session.
So sessions are found on the slot roll-up: a user has at most as many slots as the
calendar has, however many plays they own, and raw plays are never sorted per user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from playcohort.functions.columns import DAY_US, HOUR_US, floor_div, micros
from playcohort.operators.rollups import slot_rollup, slot_width


def slot_sessions(
    plays: DataFrame, gap_minutes: float = 30, slots: DataFrame | None = None
) -> DataFrame:
    """The slot roll-up with the session each slot belongs to, counted from 1 per user.

    A new session starts where the pause since the previous play is longer than the gap;
    a pause of exactly the gap continues the session. A slot roll-up that exists already can
    be given as ``slots``; the plays are not read then.
    """
    w = Window.partitionBy("userid").orderBy("slot")
    pause = F.col("first_us") - F.lag("last_us").over(w)
    starts = pause.isNull() | (pause > int(gap_minutes * 60_000_000))
    return (
        (slot_rollup(plays, gap_minutes) if slots is None else slots)
        .withColumn("starts", starts.cast("int"))
        .withColumn("pause_us", F.when(~starts, pause).otherwise(F.lit(0)))
        .withColumn("session_id", F.sum("starts").over(w))
    )


def sessionize(plays: DataFrame, gap_minutes: float = 30) -> DataFrame:
    """Every play with its ``session_id``. Joined on (userid, slot), so the plays of one
    heavy user spread over as many partitions as that user has slots."""
    slot = floor_div(micros(F.col("timestamp")), slot_width(gap_minutes))
    sessions = slot_sessions(plays, gap_minutes).select("userid", "slot", "session_id")
    return plays.withColumn("slot", slot).join(sessions, ["userid", "slot"]).drop("slot")


def session_table(plays: DataFrame, gap_minutes: float = 30) -> DataFrame:
    """One row per (userid, session_id): named tracks and length in minutes."""
    return (
        slot_sessions(plays, gap_minutes)
        .groupBy("userid", "session_id")
        .agg(
            F.sum("tracks").alias("track_count"),
            ((F.max("last_us") - F.min("first_us")) / 60_000_000.0).alias("duration_min"),
        )
    )


def listening_clock(
    plays: DataFrame,
    gap_minutes: float = 30,
    recent_days: int = 90,
    slots: DataFrame | None = None,
) -> DataFrame:
    """One row per user with every additive quantity the temporal and engagement blocks
    need: totals, session sums, active days, and plays by hour, weekday and month.

    ``cutoff_us`` lies ``recent_days`` before the user's own last play; ``recent_full``
    counts the plays of the slots that start at or after it. ``edge_slot`` is the one slot,
    if any, with plays on both sides, which only the plays themselves can settle.

    Slots are windowed and aggregated on the same partitioning by user. Callers that use
    only some columns let the optimizer drop the rest.
    """
    width = slot_width(gap_minutes)
    start = F.col("slot") * F.lit(width)
    day = floor_div(start, DAY_US)
    w = Window.partitionBy("userid").orderBy("slot")
    now = F.max("last_us").over(Window.partitionBy("userid"))
    new_day = F.coalesce((F.lag("day").over(w) != F.col("day")).cast("int"), F.lit(1))
    slots = (
        slot_sessions(plays, gap_minutes, slots)
        .withColumn("day", day)
        .select(
            "*",
            new_day.alias("new_day"),
            F.pmod(floor_div(start, HOUR_US), F.lit(24)).alias("hour"),
            F.pmod(F.col("day") + 3, F.lit(7)).alias("dow"),
            (now - F.lit(recent_days * DAY_US)).alias("cutoff_us"),
            F.month(F.date_from_unix_date(F.col("day").cast("int"))).alias("month"),
        )
    )

    def plays_where(cond: str, name: str):
        return F.expr(f"sum(if({cond}, plays, 0)) AS {name}")

    return slots.groupBy("userid").agg(
        F.sum("plays").alias("plays"),
        F.sum("tracks").alias("tracks"),
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
        F.sum("starts").alias("sessions"),
        F.sum(F.col("last_us") - F.col("first_us") + F.col("pause_us")).alias("session_us"),
        F.sum("new_day").alias("days"),
        F.max("cutoff_us").alias("cutoff_us"),
        plays_where("first_us >= cutoff_us", "recent_full"),
        F.expr("max(if(first_us < cutoff_us AND last_us >= cutoff_us, slot, NULL))").alias(
            "edge_slot"
        ),
        *[plays_where(f"hour = {h}", f"hour_{h}") for h in range(24)],
        *[plays_where(f"dow = {d}", f"dow_{d}") for d in range(7)],
        *[plays_where(f"month = {m}", f"month_{m}") for m in range(1, 13)],
    )
