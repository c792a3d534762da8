"""How many rows of a stream come too late, trigger by trigger."""

from __future__ import annotations

from collections import deque
from threading import Event

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from recollect.sources.shared import shared_path

ARRIVALS = "arrivals"
COUNTED = "trigger long, arrived long, latest timestamp, dropped long"
KEPT_TRIGGERS = 100_000


class LateRows(StreamingQueryListener):
    """Collects, of one query, what each trigger took in and what its stateful operators dropped behind the watermark.

    A row a trigger, of which the last ``kept`` are held; ``arrived`` and ``dropped`` are totals over all.
    """

    def __init__(self, kept: int = KEPT_TRIGGERS):
        self.rows: deque = deque(maxlen=kept)
        self.arrived = self.dropped = 0
        self.query_id: str | None = None
        self.ended = Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if str(progress.id) != self.query_id:
            return
        seen = progress.observedMetrics.get(ARRIVALS)
        arrived, latest = (seen["arrived"], seen["latest"]) if seen is not None else (0, None)
        dropped = sum(operator.numRowsDroppedByWatermark for operator in progress.stateOperators)
        self.rows.append((progress.batchId, arrived, latest, dropped))
        self.arrived += arrived
        self.dropped += dropped

    def onQueryTerminated(self, event) -> None:
        if str(event.id) == self.query_id:
            self.ended.set()


def in_time(events: DataFrame, late: str = "1 hour", key: str = "event_id") -> DataFrame:
    """``events`` of a stream, each once, less those that come behind the watermark; arrivals are observed before.

    Rows are dropped here one by one, not as partial sums: what follows, such as a windowed aggregation under
    the same watermark, loses none, so a query's dropped rows are those of this step.
    """
    seen = events.observe(ARRIVALS, F.count(F.lit(1)).alias("arrived"), F.max("created_at").alias("latest"))
    return seen.withWatermark("created_at", late).dropDuplicatesWithinWatermark([key])


def run_counted(stream: DataFrame, wait: float = 60.0) -> tuple[DataFrame, LateRows]:
    """Drives a stream over what is there now; its rows, from a table in the shared folder, and the listener with its counts."""
    spark = stream.sparkSession
    at, late = shared_path(spark, "stream"), LateRows()
    spark.streams.addListener(late)
    try:
        writer = stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/log")
        query = writer.trigger(availableNow=True).start()
        late.query_id = str(query.id)
        query.awaitTermination()
        if not late.ended.wait(wait):
            raise TimeoutError("the query's last progress didn't come")
    finally:
        spark.streams.removeListener(late)
    return spark.read.schema(stream.schema).parquet(f"{at}/rows"), late


def counts(spark: SparkSession, late: LateRows) -> DataFrame:
    """(trigger, arrived, latest, dropped) of the triggers that a listener holds, those without arrivals among them."""
    return spark.createDataFrame(list(late.rows), COUNTED)


def late_by_trigger(arrivals: DataFrame, late: str = "1 hour") -> DataFrame:
    """(trigger, arrived, dropped) that ``in_time`` has for rows (trigger, created_at), triggers numbered without gaps: the same as a batch.

    A trigger drops rows that aren't later than the watermark that the trigger before it ran under: the
    latest time of the triggers before that one, in whole milliseconds, less ``late``.
    """
    per = arrivals.groupBy("trigger").agg(F.max("created_at").alias("most"))
    before = Window.orderBy("trigger").rowsBetween(Window.unboundedPreceding, -2)  # a row a trigger
    marks = per.select("trigger", (F.date_trunc("millisecond", F.max("most").over(before)) - F.expr(f"INTERVAL {late}")).alias("mark"))
    is_late = F.coalesce(F.col("created_at") <= F.col("mark"), F.lit(False))
    return arrivals.join(F.broadcast(marks), "trigger").groupBy("trigger").agg(F.count("*").alias("arrived"), F.count_if(is_late).alias("dropped"))
