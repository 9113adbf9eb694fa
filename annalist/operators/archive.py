"""Archive, upsert, evidence and episode operators: all pure functions of their inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that a task holds, about, where their number grows with the table.
TASK_ROWS = 250_000


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key: idempotent ingest, latest-per-key, first-wins merges."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def top_by(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= max(1, k))


def ingest(events: DataFrame) -> DataFrame:
    """Each idempotency key once, the first arrival winning."""
    return first_by(events, ["session_id", "kind", "ts"], [F.col("event_id")])


def sessionise(events: DataFrame, keys: list[str], gap_seconds: int) -> DataFrame:
    """episode: a running number within keys; a gap over gap_seconds starts a new one, the gap itself still joins."""
    w = Window.partitionBy(*keys).orderBy("ts", "event_id")
    starts = F.lag("ts").over(w)
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(starts.cast("timestamp"))
    flagged = events.withColumn("_new", F.when(gap.isNull() | (gap > gap_seconds * 1_000_000), 1).otherwise(0))
    return flagged.withColumn("episode", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def upsert_entities(mentions: DataFrame) -> DataFrame:
    """One row for each session: first spelling by arrival, last seen by arrival, merged aliases, mentions."""
    order = F.col("event_id")
    return mentions.groupBy("session_id").agg(
        F.min_by("kind", order).alias("name"), F.max_by("ts", order).alias("last_seen"),
        F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("aliases"), F.count("*").alias("mentions"),
    )


def upsert_claims(events: DataFrame) -> DataFrame:
    """One row for each subject and predicate: evidence count, best confidence, pinned if ever pinned, validity start."""
    return events.groupBy("session_id", "kind").agg(
        F.greatest(F.lit(1), F.count_distinct("event_id")).alias("evidence"), F.max("importance").alias("confidence"),
        F.max(F.col("value") > 490).alias("pinned"), F.min_by("ts", "event_id").alias("first_seen"), F.max_by("ts", "event_id").alias("last_seen"),
    )


def merge_preferred(preferred: DataFrame, others: DataFrame, key: str, order: list, k: int) -> DataFrame:
    """Ordered union: preferred rows first, each key once, k at most for each session."""
    both = preferred.withColumn("_p", F.lit(0)).unionByName(others.withColumn("_p", F.lit(1)))
    return top_by(first_by(both, [key], [F.col("_p"), *order]), ["session_id"], [F.col("_p"), *order], k).drop("_p")


def dealing(rows: DataFrame):
    """A function that deals a table by keys over one task for each TASK_ROWS of these rows, where that is more than the session's number of shuffle partitions."""
    n = -(-rows.count() // TASK_ROWS)
    return lambda df, *keys: df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def neighbourhood(edges: DataFrame, side: str, other: str) -> DataFrame:
    """Both directions of each edge as (node, neighbour): a union of equi-filters in place of an OR join."""
    return edges.select(F.col(side).alias("node"), F.col(other).alias("neighbour"), "confidence").union(edges.select(F.col(other), F.col(side), "confidence"))


def active_leases(updates: DataFrame, ttl_seconds: int, as_of) -> DataFrame:
    """Latest value for each lease key with its first issue, and whether it has expired at as_of (a column)."""
    grouped = updates.groupBy("session_id", "kind").agg(F.min_by("ts", "event_id").alias("issued_at"), F.max_by("ts", "event_id").alias("refreshed_at"), F.max_by("value", "event_id").alias("value"))
    expires = F.col("refreshed_at") + F.expr(f"INTERVAL {ttl_seconds} SECONDS")
    return grouped.withColumn("expired", expires <= as_of)
