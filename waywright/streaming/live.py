"""Live attempts: samples come in micro-batches, and each batch's attempts are analysed anew from what is stored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import matching, timing
from ..sources.staging import staged
from ..sources.traces import clean_fixes

BUCKETS = 64

SAMPLE_FIELDS = "attempt_id string, route_id string, id string, recorded_at_ms long, latitude double, longitude double, accuracy double, speed double, heading double"


def read_fixes(spark: SparkSession, folder: str, files_a_batch: int = 1) -> DataFrame:
    """Fixes as Parquet files arrive in a folder; any other streaming source with these columns will do."""
    return spark.readStream.schema(SAMPLE_FIELDS).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def _bucket() -> Column:
    return F.pmod(F.xxhash64("attempt_id"), F.lit(BUCKETS)).cast("int")


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def live_attempts(
    fixes: DataFrame, courses: DataFrame, store: str, states: str, checkpoint: str, active: Callable[[SparkSession], DataFrame] | None = None, every: str | None = None,
) -> StreamingQuery:
    """Store each batch's clean samples, and write the state of every attempt that the batch touches.

    ``active`` gives the attempt_ids whose sessions are active when a batch comes; samples of
    others are dropped, as are those of attempts that have ended.  Late and out-of-order samples
    of open attempts are put right by order on reading; of samples with one id, the last batch's
    counts.  States go to ``states`` by batch number: what replay() gives, and where an armed
    attempt stands to its start zone; the latest number of an attempt is its state now.

    Both tables lie in folders by batch and by a hash of the attempt: a batch that runs again
    replaces itself, and it reads the folders of the attempts that it touches, not the store.
    Batches come ``every`` so often, or as long as there is input if that isn't given.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = clean_fixes(batch).withColumns({"batch": F.lit(number).cast("long"), "bucket": _bucket()})
        if active is not None:
            rows = rows.join(active(spark).select("attempt_id").distinct(), "attempt_id", "left_semi")
        if _there(spark, states):
            before = spark.read.parquet(states).filter(F.col("batch") < number)
            over = before.filter(~F.col("lifecycle").isin("armed", "active")).select("attempt_id", "bucket").distinct()
            rows = rows.join(over, ["attempt_id", "bucket"], "left_anti")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/n={number:09d}")
        own = spark.read.option("basePath", store).schema(f"{SAMPLE_FIELDS}, batch long, n int, bucket int").parquet(f"{store}/n={number:09d}")
        buckets = [r.bucket for r in own.select("bucket").distinct().collect()]  # no more than BUCKETS
        stored = spark.read.schema(f"{SAMPLE_FIELDS}, batch long, n int, bucket int").parquet(store).filter(F.col("bucket").isin(buckets) & (F.col("n") <= number))
        mine = stored.join(own.select("attempt_id").distinct(), "attempt_id", "left_semi")
        last = mine.groupBy("attempt_id", "id").agg(F.max_by(F.struct(*[c for c in mine.columns if c not in ("attempt_id", "id", "batch", "n", "bucket")]), "batch").alias("x"))
        samples = last.select("attempt_id", "id", "x.*")
        matched = staged(matching.match_samples(samples, courses), "live-matched")
        runs = staged(timing.replay(matched, courses), "live-runs")
        zones = timing.start_zone_status(runs, matched, courses, runs).withColumnRenamed("status", "start_zone")
        state = runs.join(zones, "attempt_id").withColumn("start_zone", F.when(F.col("lifecycle") == "armed", F.col("start_zone")).otherwise("locating"))
        state.withColumns({"batch": F.lit(number).cast("long"), "bucket": _bucket()}).write.mode("overwrite").partitionBy("bucket").parquet(f"{states}/n={number:09d}")

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return fixes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def latest_states(spark: SparkSession, states: str) -> DataFrame:
    """Each attempt's state after the last batch that touched it."""
    rows = spark.read.parquet(states).drop("n", "bucket")
    names = [c for c in rows.columns if c not in ("attempt_id", "batch")]
    return rows.groupBy("attempt_id").agg(F.max_by(F.struct(*names), "batch").alias("x")).select("attempt_id", "x.*")


def windowed_activity(fixes: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Samples and distinct attempts in tumbling event-time windows, late samples up to the watermark included."""
    at = fixes.withColumn("at", F.timestamp_millis("recorded_at_ms")).withWatermark("at", late)
    return at.groupBy(F.window("at", width)).agg(F.count("*").alias("samples"), F.approx_count_distinct("attempt_id").alias("attempts")).select("window.start", "window.end", "samples", "attempts")
