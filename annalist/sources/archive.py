"""The archive's tables from the driver's tables, and readers and writers of archive files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCOPE = T.StructType([T.StructField(k, T.StringType()) for k in ("tenant", "namespace", "workspace", "project")])
RELATION_HINT = T.StructType([T.StructField("src", T.StringType()), T.StructField("dst", T.StringType()), T.StructField("type", T.StringType()), T.StructField("confidence", T.DoubleType())])
HINTS = T.StructType([T.StructField("entities", T.ArrayType(T.StringType())), T.StructField("relations", T.ArrayType(RELATION_HINT)), T.StructField("episode_hint", T.StringType()), T.StructField("pin", T.BooleanType())])
EVENT = T.StructType(
    [T.StructField("event_id", T.StringType()), T.StructField("timestamp", T.StringType()), T.StructField("scope", SCOPE), T.StructField("session_id", T.StringType())]
    + [T.StructField(k, T.StringType()) for k in ("source_app", "source_module", "actor", "kind", "raw_text", "normalized_text", "structured_payload")]
    + [T.StructField("hints", HINTS), T.StructField("importance", T.DoubleType()), T.StructField("confidence", T.DoubleType()), T.StructField("idempotency_key", T.StringType())]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The longest method that the JVM compiles, in bytes; longer ones it interprets.
LONGEST_METHOD = 8000


def settled(df: DataFrame, many_rules: bool = False) -> DataFrame:
    """The rows as written into the folder that the cluster shares for checkpoints, for what is read several times; a lost executor costs a re-read.

    They lie there as Parquet, so that a reader of few columns reads those alone, and small tables are known to be small.
    many_rules: whether the rows are made by so many expressions that the one method made of a stage's would be too long to be compiled.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="annalist-"))  # a local session that names none, as in tests
    path = f"{sc.getCheckpointDir()}/settled-{uuid.uuid4().hex}"
    limit = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(limit)
    if many_rules:  # such stages are run expression by expression then, in methods that are compiled
        spark.conf.set(limit, min(int(before), LONGEST_METHOD))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(limit, before)
    return spark.read.schema(df.schema).parquet(path)


def scope_key(scope) -> F.Column:
    return F.lower(F.concat_ws("::", *(F.trim(scope[k]) for k in ("tenant", "namespace", "workspace", "project"))))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Archive events from JSON lines with a fixed schema; times are UTC instants, the text form is kept."""
    return spark.read.schema(EVENT).json(path).withColumn("ts", F.to_timestamp("timestamp")).withColumn("scope_key", scope_key(F.col("scope")))


def write_events(events: DataFrame, path: str) -> None:
    """Appends to a Parquet archive partitioned by scope, so that every read prunes to its scopes."""
    events.write.mode("append").partitionBy("scope_key").parquet(path)


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as an archive: session is the user, kind the type, importance from the value."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("session_id"), F.col("event_type").alias("kind"), "ts", "value", F.least(F.lit(1.0), F.col("value") / 500).alias("importance"), "props")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))


def editorial_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels as sparse editorial states."""
    toxic, good = F.coalesce("toxic", F.lit(0)) == 1, F.coalesce("quality", F.lit(0)) == 1
    return table(spark, sf_dir, "labels").select(
        "doc_id", F.when(toxic, "retired").when(good, "remembered").otherwise("candidate").alias("remember"),
        F.when(good & ~toxic, "active").otherwise("suppressed").alias("activation"), F.when(good, 0.6).otherwise(0.2).alias("weight"),
    )
