"""The audit log as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.functions.scalars import key
from corvane.operators.model import _k
from corvane.session import removed_at_end, shared_dir
from corvane.sources import schemas


def audit_stream(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """The audit log as an unbounded table: Parquet files as they arrive in a folder, or under a pattern."""
    schema = schemas.schema("audit_log")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def daily_activity(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Events per day and result for a live stream, with rows later than `late` behind the newest left out; ids that come
    again within that time count once, whichever comes first. Rows without an id are left out."""
    seen = events.withColumn("id", key(F.col("id"))).filter("id IS NOT NULL").withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["id"])
    return seen.groupBy(F.window("timestamp", "1 day").start.alias("day"), F.upper("result").alias("result")).agg(F.count("*").alias("n_events"))


def drained(spark: SparkSession, folder: str) -> DataFrame:
    """All that has arrived, as counts per day and result, by an available-now run. Ids delivered again count once, at their
    earliest instant, whatever the result then; rows without an id are left out.

    Each micro-batch writes what it has per id to a folder of its own number, so a batch that is run again after a
    failure replaces itself; the result takes one row per id of all parts. A folder with nothing in it gives no rows.
    """
    at = f"{shared_dir(spark)}/corvane-stream-{uuid.uuid4().hex}"
    removed_at_end(spark, at)

    def keep(batch: DataFrame, number: int) -> None:
        one = _first(batch.select(key(F.col("id")).alias("id"), F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), F.upper("result").alias("result")))
        one.write.mode("overwrite").parquet(f"{at}/parts/batch={number}")

    run = audit_stream(spark, folder).writeStream.foreachBatch(keep).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    parts = spark.createDataFrame([], PART)
    if run.recentProgress and any(p["numInputRows"] for p in run.recentProgress):
        parts = spark.read.schema(PART).parquet(f"{at}/parts")
    return _first(parts).groupBy(F.date_format("timestamp", "yyyy-MM-dd").alias("day"), "result").agg(F.count("*").alias("n_events"))


PART = "id string, timestamp timestamp_ntz, result string"


def _first(rows: DataFrame) -> DataFrame:
    return rows.filter("id IS NOT NULL").groupBy("id").agg(F.min(F.struct("timestamp", "result")).alias("_r")).select("id", "_r.*")


QUERIES = {"audit_stream_daily": lambda spark, sf_dir: drained(spark, f"{sf_dir}/audit_log.parque[t]")}
SQL = {
    "audit_stream_daily": f"""WITH one AS (SELECT "timestamp", upper(result) AS result FROM audit_log WHERE {_k('id')} IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY {_k('id')} ORDER BY "timestamp" NULLS FIRST, upper(result) NULLS FIRST) = 1)
        SELECT strftime("timestamp", '%Y-%m-%d') AS day, result, count(*) AS n_events FROM one GROUP BY ALL""",
}
