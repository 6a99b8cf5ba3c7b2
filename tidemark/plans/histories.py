"""List-valued behaviour histories from an event log."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timefeat import floor_div

# Events whose lists one task unfolds.
EVENTS_PER_TASK = 10_000


def build_histories(
    events: DataFrame,
    fields: Mapping[str, Column],
    keep: Sequence[str],
    user: str = "user_id",
    time: str = "timestamp",
    tie: str = "event_id",
    *,
    max_len: int,
) -> DataFrame:
    """For every event the user's earlier events, newest first, at most ``max_len``.

    ``fields`` become aligned list columns; ``keep`` are the event's own columns.

    One user may hold a large part of the log, so no step gathers a user. Events are
    numbered through counts per (user, hour) and cut into runs of ``max_len``. A group is
    one run with the run before it, at most ``2 * max_len`` events, which is all that the
    histories of the run can hold.
    """
    hour = floor_div(F.col(time), 3600)
    log = events.select(
        user, time, tie, hour.alias("_hour"), F.struct(*keep).alias("_own"),
        F.struct(*[c.alias(n) for n, c in fields.items()]).alias("_seen"),
    )
    earlier = Window.partitionBy(user).orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        events.groupBy(user, hour.alias("_hour"))
        .agg(F.count("*").alias("_n"))
        .select(user, "_hour", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    )
    in_hour = Window.partitionBy(user, "_hour").orderBy(time, tie)
    ranked = log.join(base, [user, "_hour"]).select(
        user,
        (F.col("_base") + F.row_number().over(in_hour) - 1).alias("_rank"),
        "_own",
        "_seen",
    )
    # Every event goes to its own run and, without its own columns, to the run after it.
    run = F.call_function("div", F.col("_rank"), F.lit(max_len).cast("long"))
    copies = ranked.select(
        user,
        "_rank",
        "_seen",
        "_own",
        run.alias("_at"),
        F.explode(F.array(run, run + 1)).alias("_run"),
    )
    is_own = F.col("_run") == F.col("_at")
    entry = F.struct("_rank", "_seen", F.when(is_own, F.col("_own")).alias("_own"))
    # The number of partitions is given: narrow events unfold into long lists here, so
    # partitions merged by the size of their input would make overlong tasks. It grows
    # with the events, counted once, and so a task does not.
    least = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, -(-events.count() // EVENTS_PER_TASK))
    runs = copies.repartition(parts, user, "_run").groupBy(user, "_run").agg(
        F.sort_array(F.collect_list(entry), asc=False).alias("_entries"),
        F.count_if(is_own).cast("int").alias("_n"),
    )
    # The lists of a run are taken apart once, before its rows are unfolded from it.
    lists = [F.col(f"_entries._seen.{n}").alias(f"_all_{n}") for n in fields]
    packed = runs.select(user, "_run", *lists, F.slice("_entries", 1, F.col("_n")).alias("_rows"))
    rows = packed.select("*", F.posexplode("_rows").alias("_i", "_e"))
    return rows.select(
        user,
        F.col("_run").alias("run"),
        *[F.col(f"_e._own.{c}").alias(c) for c in keep],
        *[F.slice(F.col(f"_all_{n}"), F.col("_i") + 2, F.lit(max_len)).alias(n) for n in fields],
    )
