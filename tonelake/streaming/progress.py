"""Progress of a running job from its event table or stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from tonelake.operators.library import file_name

ITEM_CHARS = 50


def short_item(path: Column) -> Column:
    return F.substring(file_name(path), 1, ITEM_CHARS)


def progress(events: DataFrame, key: str = "run_id") -> DataFrame:
    """Current, total, percent, elapsed and remaining seconds per run; no estimate when done.

    ``events(run_id, ts, current, total)``, as a batch table. One aggregation with map-side combine.
    """
    seen = events.withColumns({"first": F.col("ts").cast("timestamp"), "last": F.col("ts").cast("timestamp")})
    return estimates(seen, key)


def estimates(parts: DataFrame, key: str = "run_id") -> DataFrame:
    """:func:`progress` from partial sums of runs: ``current, total, first, last``, any number of rows each."""
    df = parts.groupBy(key).agg(
        F.max("current").alias("current"), F.max("total").alias("total"),
        F.min("first").alias("_from"), F.max("last").alias("_to"),
    )
    df = df.withColumn("_e", (F.unix_micros("_to") - F.unix_micros("_from")) / 1e6)
    rate = F.col("current") / F.nullif(F.col("_e"), F.lit(0.0))
    eta = F.when((F.col("current") > 0) & (F.col("total") > 0), (F.col("total") - F.col("current")) / F.nullif(rate, F.lit(0.0)))
    percent = F.when(F.col("total") > 0, F.col("current") / F.nullif(F.col("total").cast("double"), F.lit(0.0)) * 100).otherwise(0.0)
    return df.select(
        key, "current", "total", F.round("_e", 1).alias("elapsed_seconds"),
        F.round(F.nullif(eta, F.lit(0.0)), 1).alias("eta_seconds"), F.round(percent, 1).alias("percent"),
    )


STATE = "current long, total long, first long, last long"  # times in microseconds


class RunState(StatefulProcessor):
    """What is known of a run: its furthest count, its first and its last event.

    A run that has had no event for ``idle`` seconds of event time is over: a timer writes its last row,
    marked as ended, and forgets it. Events of it that come later still begin a new state, and whoever
    reads the table merges both.
    """

    def __init__(self, idle: float):
        self.idle = int(idle * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = [tuple(self.run.get())] if self.run.exists() else []
        seen = known + [(r.current, r.total, r.at, r.at) for r in rows]
        most = lambda i: max((x[i] for x in seen if x[i] is not None), default=None)
        now = (most(0), most(1), min((x[2] for x in seen if x[2] is not None), default=None), most(3))
        if known and now == known[0]:
            return  # doubled events
        self.run.update(now)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if now[3] is not None:
            self.handle.registerTimer(now[3] // 1000 + self.idle)
        yield Row(run_id=key[0], current=now[0], total=now[1], first=now[2], last=now[3], ended=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.run.exists():
            current, total, first, last = self.run.get()
            self.run.clear()
            yield Row(run_id=key[0], current=current, total=total, first=first, last=last, ended=True)

    def close(self) -> None:
        pass


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_states(events: DataFrame, late: str = "1 hour", idle: float = 3600.0) -> DataFrame:
    """A stream of the runs' states after every micro-batch that changes them: run_id, current, total, first, last, ended.

    Keyed state is what stays between batches, so a run may have any number of events. Events more than
    ``late`` behind the newest of earlier batches are dropped.
    """
    key = events.schema["run_id"].dataType.simpleString()
    at = F.col("ts").cast("timestamp")
    rows = events.select("run_id", at.alias("ts"), F.unix_micros(at).alias("at"), F.col("current").cast("long").alias("current"), F.col("total").cast("long").alias("total"))
    grouped = rows.withWatermark("ts", late).groupBy("run_id")
    states = grouped.transformWithState(RunState(idle), f"run_id {key}, current long, total long, first long, last long, ended boolean", "Append", "EventTime")
    return states.withColumns({c: F.timestamp_micros(c) for c in ("first", "last")})


def progress_stream(events: DataFrame, table: str, checkpoint: str, late: str = "1 hour", idle: float = 3600.0) -> StreamingQuery:
    """Keep a table of run states, appended to by every micro-batch; :func:`estimates` reads it.

    Rows are partial sums, so a repeated batch changes nothing. Ends when all present events are read. Keyed
    state with timers needs the RocksDB store; the query takes its settings when it starts, so the session keeps its own.
    """
    conf = events.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKSDB)
    try:
        writer = run_states(events, late, idle).writeStream.format("parquet").option("path", table)
        return writer.option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        conf.set(PROVIDER, before) if before else conf.unset(PROVIDER)


METRICS = "ingest"


def observed(batch: DataFrame, item: Column, failed: Column | None = None) -> DataFrame:
    """``batch`` with metrics for :class:`BatchCallback`: its rows, how many failed, and the last item by name."""
    bad = F.count_if(failed) if failed is not None else F.lit(0).cast("long")
    return batch.observe(METRICS, F.count(F.lit(1)).alias("rows"), bad.alias("failed"), F.max(short_item(item)).alias("item"))


class BatchCallback(StreamingQueryListener):
    """Calls ``report`` after every micro-batch of an :func:`observed` stream: batch number, rows, failures, current item.

    Rows and failures are also summed over the batches, as ``current`` and ``errors``.
    """

    def __init__(self, report: Callable[[dict], None]):
        self.report = report
        self.current = self.errors = 0

    def onQueryStarted(self, event) -> None:
        self.report({"stage": "started"})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = p.observedMetrics.get(METRICS)
        row = seen.asDict() if seen is not None else {"rows": p.numInputRows, "failed": 0, "item": None}
        self.current, self.errors = self.current + row["rows"], self.errors + row["failed"]
        self.report({"stage": "scanning", "batch": p.batchId, **row, "current": self.current, "errors": self.errors})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.report({"stage": "complete", "current": self.current, "errors": self.errors})
