"""Streaming forms: idempotent ingest, session windows, lease state, incremental derivation, a change feed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.window import Window


def stored(spark: SparkSession, path: str, schema) -> DataFrame:
    """A Parquet table, empty before it is first written."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def ingest_batch(archive_path: str, key: list[str], order: str, scope: str | None = None, then: Callable[[DataFrame, int], None] | None = None):
    """A foreachBatch sink: rows whose key the archive lacks are appended, once, of a batch's equal keys the first by order.

    A replayed batch adds nothing. With a scope the archive is partitioned by it and only the batch's scopes are read.
    then is given what will be added and the batch's number before it is, for incremental derivation; where the batch
    fails after it, it is called again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark: SparkSession = batch.sparkSession
        first = batch.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("_n = 1").drop("_n")
        known = stored(spark, archive_path, batch.schema)
        if scope:
            known = known.join(F.broadcast(batch.select(scope).distinct().limit(MOST_SCOPES)), scope, "left_semi") if few_scopes(batch, scope) else known
        new = first.join(known.select(*key), key, "left_anti")
        if then is not None:
            then(new, batch_id)
        (new.write.mode("append").partitionBy(scope) if scope else new.write.mode("append")).parquet(archive_path)

    return write


#: Scopes of a batch that the archive's partitions are pruned by; a batch of more reads them all.
MOST_SCOPES = 1000


def few_scopes(batch: DataFrame, scope: str) -> bool:
    return batch.select(scope).distinct().limit(MOST_SCOPES + 1).count() <= MOST_SCOPES


def episodes(events: DataFrame, gap: str = "20 minutes", late: str = "1 hour") -> DataFrame:
    """Session windows by session and kind; the gap's end still joins."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("session_id", "kind", F.session_window("ts", gap)).agg(F.count("*").alias("n"))


def deduplicated(events: DataFrame, key: list[str], late: str = "1 hour") -> DataFrame:
    """Keys once within the watermark: bounded state, against ingest_batch's unbounded memory."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def leases(updates: DataFrame, late: str = "1 hour") -> DataFrame:
    """Leases (session_id, lease_key, ts, ttl, value) as keyed state: each update refreshes its lease, a lease ends ttl seconds after its latest update.

    Gives a row (status active) with every change and one (status expired) when the watermark passes the end; a late
    update with an earlier time than the state's refreshes nothing, and an update that comes after the end begins anew.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, batches, state):
        import pandas as pd

        issued, latest, ttl, value = state.get if state.exists else (None, None, None, None)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"session_id": [key[0]], "lease_key": [key[1]], "issued_at": [pd.Timestamp(issued, unit="us")], "refreshed_at": [pd.Timestamp(latest, unit="us")], "value": [value], "status": ["expired"]})
            return
        for batch in batches:
            for row in batch.sort_values("ts").itertuples():
                at = row.ts.value // 1000
                if latest is not None and at > latest + ttl * 1_000_000:
                    issued = latest = None
                if latest is None or at >= latest:
                    issued, latest, ttl, value = (at if issued is None else issued), at, int(row.ttl), float(row.value)
        if latest is None:
            return
        state.update((issued, latest, ttl, value))
        state.setTimeoutTimestamp(max(latest // 1000 + ttl * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"session_id": [key[0]], "lease_key": [key[1]], "issued_at": [pd.Timestamp(issued, unit="us")], "refreshed_at": [pd.Timestamp(latest, unit="us")], "value": [value], "status": ["active"]})

    rows = updates.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy("session_id", "lease_key").applyInPandasWithState(
        step, "session_id long, lease_key string, issued_at timestamp, refreshed_at timestamp, value double, status string", "issued long, latest long, ttl long, value double", "update", GroupStateTimeout.EventTimeTimeout
    )


class ChangeFeed(StreamingQueryListener):
    """Tells a callback of each batch that brought rows: the query's name, the batch and its number of rows."""

    def __init__(self, tell: Callable[[str, int, int], None]):
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.numInputRows:
            self.tell(p.name, p.batchId, p.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
