"""Task progress: the same logic over a batch or a stream of events.

Events: task_id, ts, seq, stage, progress, status.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Ranks of states, progress by stage.
STATUS_RANK = {"pending": 0, "running": 1, "done": 2, "failed": 2}
STAGE_PROGRESS = {"parse_word": 0.02, "segment_word": 0.06, "recognise": 0.10, "segment_pdf": 0.72, "align": 0.78, "compare": 0.85, "gate": 0.95, "done": 1.0}


def status_rank(status: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in STATUS_RANK.items() for x in p]), status)


def latest(events: DataFrame) -> DataFrame:
    """The last stage and progress of each task, by (ts, seq); works in update mode on a stream."""
    order = F.struct("ts", "seq")
    return events.groupBy("task_id").agg(
        F.max_by("stage", order).alias("stage"), F.max_by("progress", order).alias("progress"), F.max_by("status", order).alias("status"), F.count("*").alias("n_events")
    )


def elapsed(events: DataFrame) -> DataFrame:
    seconds = F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))
    return events.groupBy("task_id").agg((seconds / 1_000_000).alias("elapsed_s"))


def monotone(events: DataFrame) -> DataFrame:
    """Events whose status is no step back: its rank is at least the highest before it."""
    order = Window.partitionBy("task_id").orderBy("ts", "seq")
    before = F.max(status_rank(F.col("status"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("before", before).where(F.col("before").isNull() | (status_rank(F.col("status")) >= F.col("before"))).drop("before")


def monotone_stream(events: DataFrame) -> DataFrame:
    """As ``monotone`` on a stream: a task's highest rank is its state."""
    schema = "task_id long, ts timestamp, seq int, stage string, progress double, status string"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get[0] if state.exists else -1
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        kept = []
        for i, status in enumerate(rows["status"]):
            if (r := STATUS_RANK.get(status, -1)) >= best:
                best = r
                kept.append(i)
        state.update((best,))
        yield rows.iloc[kept][["task_id", "ts", "seq", "stage", "progress", "status"]]

    return events.groupBy("task_id").applyInPandasWithState(run, schema, "best int", "append", GroupStateTimeout.NoTimeout)


def admission(events: DataFrame) -> DataFrame:
    """After each event the number of tasks that have begun and not ended: what an admission limit is held against.

    A task adds one at its first event and takes one off at its first terminal
    event. Changes are summed within a day and days carry their totals over, so
    no task sees all events.
    """
    terminal = F.col("status").isin("done", "failed")
    ends = events.groupBy("task_id").agg(F.min(F.struct("ts", "seq")).alias("b"), F.min(F.when(terminal, F.struct("ts", "seq"))).alias("e"))
    begun = ends.select("task_id", F.col("b.ts").alias("ts"), F.lit(1).alias("step"))
    ended = ends.where("e is not null").select("task_id", F.col("e.ts").alias("ts"), F.lit(-1).alias("step"))
    steps = begun.unionByName(ended).withColumn("day", F.to_date("ts"))
    days = steps.groupBy("day").agg(F.sum("step").alias("net"))
    carried = days.withColumn("open", F.coalesce(F.sum("net").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    order = Window.partitionBy("day").orderBy("ts", F.desc("step"), "task_id").rowsBetween(Window.unboundedPreceding, 0)
    running = steps.join(carried.select("day", "open"), "day").withColumn("running", F.col("open") + F.sum("step").over(order))
    return running.select("task_id", "ts", "step", F.col("running").cast("long").alias("running"))


def unseen(events: DataFrame, seen: DataFrame) -> DataFrame:
    """A reader's next events: those after the last one it has (``seen``: task_id, seq), up to the first terminal one, which is ``final``."""
    terminal = F.col("status").isin("done", "failed")
    last = events.groupBy("task_id").agg(F.min(F.when(terminal, F.col("seq"))).alias("__end"))
    open_ = events.join(last, "task_id").join(seen.select("task_id", F.col("seq").alias("__seen")), "task_id", "left")
    new = open_.where((F.col("seq") > F.coalesce("__seen", F.lit(-1))) & (F.col("__end").isNull() | (F.col("seq") <= F.col("__end"))))
    return new.withColumn("final", F.coalesce(F.col("seq") == F.col("__end"), F.lit(False))).drop("__end", "__seen")


def tail_stream(events: DataFrame) -> DataFrame:
    """Each event once as it comes, until the task's terminal one (``final``); what comes after that is left out."""
    schema = "task_id long, ts timestamp, seq int, stage string, progress double, status string, final boolean"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, ended = state.get if state.exists else (-1, False)
        rows = pd.concat(list(batches)).sort_values("seq").drop_duplicates("seq")
        rows = rows[rows["seq"] > last] if not ended else rows.iloc[:0]
        rows = rows.assign(final=rows["status"].isin(["done", "failed"]))
        rows = rows[rows["final"].cumsum() - rows["final"] == 0]
        if len(rows):
            last, ended = int(rows["seq"].iloc[-1]), bool(rows["final"].iloc[-1])
        state.update((last, ended))
        yield rows[["task_id", "ts", "seq", "stage", "progress", "status", "final"]]

    return events.groupBy("task_id").applyInPandasWithState(run, schema, "last int, ended boolean", "append", GroupStateTimeout.NoTimeout)


def stage_progress(stage: Column, share: Column) -> Column:
    """Progress of a task whose present stage is done by ``share``: between the stage's beginning and the next one's."""
    names = list(STAGE_PROGRESS)
    ends = {n: STAGE_PROGRESS[names[min(i + 1, len(names) - 1)]] for i, n in enumerate(names)}
    table = lambda d: F.create_map(*[F.lit(x) for p in d.items() for x in p])
    begin, end = F.try_element_at(table(STAGE_PROGRESS), stage), F.try_element_at(table(ends), stage)
    return begin + (end - begin) * F.least(F.greatest(F.coalesce(share, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def stage_times(events: DataFrame) -> DataFrame:
    """Mean, least and most seconds of each stage over all tasks: from a stage's first event to the first of the next."""
    begun = events.groupBy("task_id", "stage").agg(F.min("ts").alias("ts"))
    following = F.lead("ts").over(Window.partitionBy("task_id").orderBy("ts", "stage"))
    spent = begun.withColumn("s", (F.unix_micros(following) - F.unix_micros("ts")) / 1_000_000).where("s is not null")
    return spent.groupBy("stage").agg(F.count("*").alias("n"), F.avg("s").alias("mean_s"), F.min("s").alias("min_s"), F.max("s").alias("max_s"))


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events by window and stage; a watermark bounds the state on a stream."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    counted = marked.groupBy(F.window("ts", width).alias("w"), "stage").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), "stage", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    found = marked.groupBy("task_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return found.select("task_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, late: str = "1 day") -> DataFrame:
    """One event for each (task_id, seq)."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["task_id", "seq"])
    return events.dropDuplicates(["task_id", "seq"])


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that a bounded source has, through the stream, as a table in memory (for tests and small reports)."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
