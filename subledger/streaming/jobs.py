"""The periodic jobs as Structured Streaming: reminders that are queued once, savings of intervals as they close, what a conversation is about, and the loop that runs them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import DateType, LongType, StructField, StructType

JOB_KEY = ["subscription_id", "kind", "channel", "destination", "scheduled_for"]
INTERVALS = "subscription_id long, new_status string, started date, ended date, days long"
MEMORY = "conv_id long, turn int, about long"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def insert_once(table: str, key: list[str], time: str = "scheduled_for") -> Callable[[DataFrame, int], None]:
    """A sink that adds a batch's rows whose key the Parquet table doesn't have yet, for ever. A batch that is written again replaces what it wrote before, so a restart adds nothing twice.

    ``time`` is a part of the key, and the table is laid out by its day: equal keys lie in one day, so a batch reads the partitions of its own days alone, however long the table has grown.
    """
    if time not in key:
        raise ValueError("time is a part of the key")

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates(key).withColumn("day", F.to_date(time))
        if _exists(spark, table):
            days = [r.day for r in rows.select("day").distinct().collect()]  # as many as a reminder horizon has
            held = StructType([*batch.schema.fields, StructField("day", DateType()), StructField("batch", LongType())])
            old = spark.read.schema(held).parquet(table).where((F.col("day").isin([d for d in days if d]) | (F.col("day").isNull() & F.lit(None in days))) & (F.col("batch") != number))
            match = [rows[k].eqNullSafe(old[k]) for k in key]
            rows = rows.join(old, match, "left_anti")
        rows.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(table)

    return write


def first_within(stream: DataFrame, key: list[str], time: str, lateness: str = "1 day") -> DataFrame:
    """The first row of each key, where repetitions come within ``lateness`` of each other by ``time``; a key is forgotten after that."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark(key)


def _close(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, lateness_ms: int) -> Iterator[pd.DataFrame]:
    """Open stops are the state, and the activations that a late stop may still need; the first activation strictly after a stop's start closes it, whichever of them arrives first."""
    (subscription,) = key
    statuses, starts, activations, seen = (list(x) for x in state.get) if state.exists else ([], [], [], [])
    for pdf in batches:
        stops = pdf[pdf["new_status"] != "ACTIVE"]
        statuses += stops["new_status"].tolist()
        starts += stops["effective_date"].tolist()
        active = pdf[pdf["new_status"] == "ACTIVE"]
        activations += active["effective_date"].tolist()
        seen += (active["recorded_at"].astype("int64") // 1_000_000 if str(active["recorded_at"].dtype).endswith("[ns]") else active["recorded_at"].astype("datetime64[ms]").astype("int64")).tolist()
    begun, order = pd.to_datetime(pd.Series(starts, dtype=object)), sorted(range(len(activations)), key=activations.__getitem__)
    dates = pd.to_datetime(pd.Series([activations[i] for i in order], dtype=object))
    nth = dates.searchsorted(begun, side="right") if len(dates) and len(begun) else np.full(len(begun), len(dates))
    done = [i for i, n in enumerate(nth) if n < len(dates)]
    yield pd.DataFrame([(subscription, statuses[i], starts[i], activations[order[nth[i]]], (activations[order[nth[i]]] - starts[i]).days) for i in done], columns=["subscription_id", "new_status", "started", "ended", "days"])
    now = state.getCurrentWatermarkMs()
    left, kept = [i for i, n in enumerate(nth) if n == len(dates)], [i for i in range(len(activations)) if seen[i] >= now]
    if left or kept:
        state.update(([statuses[i] for i in left], [starts[i] for i in left], [activations[i] for i in kept], [seen[i] for i in kept]))
        if kept:
            state.setTimeoutTimestamp(max(min(seen[i] for i in kept), now) + lateness_ms + 1)
    elif state.exists:
        state.remove()


def closed_intervals(history: DataFrame, lateness: dt.timedelta = dt.timedelta(days=7)) -> DataFrame:
    """A stream of status changes to a stream of closed stops. A stop may come up to ``lateness`` after the activation that ends it, by ``recorded_at``; then its activation is forgotten, and it counts as open.

    What is kept is the open stops, and each activation for ``lateness``; a subscription with neither has no state.
    """
    told = history.withWatermark("recorded_at", f"{int(lateness.total_seconds())} seconds")
    run = partial(_close, lateness_ms=int(lateness.total_seconds() * 1000))
    return told.groupBy("subscription_id").applyInPandasWithState(lambda k, b, s: run(k, b, s), INTERVALS, "statuses array<string>, starts array<date>, activations array<date>, seen array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def _remember(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, time: str | None, idle_ms: int) -> Iterator[pd.DataFrame]:
    """The state is the last subscription mentioned; a turn that mentions none, but points back, is about it."""
    if state.hasTimedOut:
        state.remove()
        return
    (conversation,) = key
    before = state.get[0] if state.exists else None
    turns = pd.concat(list(batches)).sort_values("turn", kind="stable")
    own = turns["mentioned"].astype("Int64")
    known = pd.concat([pd.Series([before], dtype="Int64"), own], ignore_index=True).ffill()
    last = known.iloc[:-1].set_axis(turns.index)
    yield pd.DataFrame({"conv_id": conversation, "turn": turns["turn"], "about": own.where(own.notna(), last.where(turns["points"].astype("boolean").fillna(False)))})
    after = known.iloc[-1]
    if pd.isna(after):
        if state.exists:
            state.remove()
        return
    state.update((int(after),))
    if time:
        newest = int(turns[time].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + idle_ms + 1)


def conversation_memory(turns: DataFrame, time: str | None = None, idle: dt.timedelta = dt.timedelta(hours=24)) -> DataFrame:
    """A stream of turns (conv_id, turn, mentioned, points) with the subscription that each is about; a conversation's batches come in order. One that has mentioned nothing isn't kept.

    With a ``time`` column, a conversation that is idle for ``idle`` by the stream's watermark is forgotten; without one each is kept. (A limit by the clock would keep a run over what is there from ever ending.)
    """
    run = partial(_remember, time=time, idle_ms=int(idle.total_seconds() * 1000))
    told = turns.withWatermark(time, f"{int(idle.total_seconds())} seconds") if time else turns
    return told.groupBy("conv_id").applyInPandasWithState(lambda k, b, s: run(k, b, s), MEMORY, "last long", "append", GroupStateTimeout.EventTimeTimeout if time else GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, each_batch: Callable[[DataFrame, int], None], checkpoint: str) -> list[int]:
    """Work off all that is there now. ``each_batch`` gets (batch, number) and must be idempotent for a number. Returns how many keys have state after each batch."""
    query = stream.writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress]


def cycle(spark: SparkSession, steps: dict[str, Callable[[SparkSession], None]]) -> dict[str, str | None]:
    """Run the steps in order, each by itself: {step: its error, or None}. One that fails doesn't stop the others."""
    errors: dict[str, str | None] = {}
    for name, step in steps.items():
        try:
            step(spark)
            errors[name] = None
        except Exception as error:  # what failed is reported, and is due again in the next cycle
            errors[name] = f"{type(error).__name__}: {error}"
    return errors


def every(ticks: DataFrame, steps: dict[str, Callable[[SparkSession], None]], checkpoint: str, interval: str = "15 minutes"):
    """The job loop: a cycle for each trigger that finds new ``ticks`` (such as a rate source). Returns the running query."""
    return ticks.writeStream.foreachBatch(lambda batch, _: cycle(batch.sparkSession, steps) and None).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()
