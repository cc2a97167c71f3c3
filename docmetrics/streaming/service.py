"""The recognition service as streams: bounded intake, validation, jobs with an age limit, metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

QUEUE = 32
MAX_BYTES = 20 * 2**20
MAX_PAGES = 20
TTL_SECONDS = 3600
RETRY_AFTER = 5


def utc(ts: Column) -> Column:
    """Event time as a timestamp with time zone, which watermarks need."""
    return ts.cast("timestamp")


def intake(spark: SparkSession, path: str, schema: str, queue: int = QUEUE) -> DataFrame:
    """Requests from a folder, at most ``queue`` files a batch: what is beyond waits, as in a bounded queue."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", queue).parquet(path)


def validation(size: Column, pages: Column, kind: Column, mode: Column, readable: Column, kinds: list[str], modes: list[str]) -> Column:
    """Status of a request: 200, or why it is refused."""
    return (
        F.when(size == 0, 400)
        .when(size > MAX_BYTES, 413)
        .when(kind.isNotNull() & ~kind.isin(kinds), 422)
        .when(~mode.isin(modes), 422)
        .when(~F.coalesce(readable, F.lit(False)), 415)
        .when(pages > MAX_PAGES, 413)
        .otherwise(200)
    )


def admission(place: Column, waiting: Column | int = 0, queue: int = QUEUE) -> Column:
    """Struct (status, retry_after) of a request by its place, from 0, among those that arrive together: beyond a full queue it is refused with 503 and told when to come back."""
    waiting = F.lit(waiting) if isinstance(waiting, int) else waiting
    full = place + waiting >= queue
    return F.struct(F.when(full, 503).otherwise(200).alias("status"), F.when(full, RETRY_AFTER).alias("retry_after"))


def job_times(jobs: DataFrame, queued: str = "queued", started: str = "started", done: str = "done") -> DataFrame:
    """Jobs with their wait in the queue and their time in work, in milliseconds."""
    ms = lambda a, b: F.round((F.unix_micros(F.col(b)) - F.unix_micros(F.col(a))) / 1000).cast("bigint")
    return jobs.withColumns({"queue_wait_ms": ms(queued, started), "elapsed_ms": ms(started, done)})


def split_valid(requests: DataFrame, status: Column) -> tuple[DataFrame, DataFrame]:
    """Requests to work on, and refused ones with their status."""
    marked = requests.withColumn("status", status)
    return marked.where("status = 200"), marked.where("status <> 200")


def unexpired(jobs: DataFrame, now: Column, ttl: int = TTL_SECONDS, created: str = "created") -> DataFrame:
    """Jobs young enough to keep: eviction on insert."""
    return jobs.where(F.col(created) >= now - F.expr(f"INTERVAL {ttl} SECONDS"))


def latest_status(updates: DataFrame, key: str = "job", order: str = "ts") -> DataFrame:
    """Last state of every job from its updates."""
    return updates.groupBy(key).agg(F.max_by("status", order).alias("status"), F.min(order).alias("created"), F.max(order).alias("updated"))


def run_jobs(requests: DataFrame, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Works off a stream batch by batch into a table; a batch that is run again replaces its own rows."""

    def one(batch: DataFrame, number: int) -> None:
        out = work(batch).withColumn("batch", F.lit(number))
        out.write.mode("overwrite").partitionBy("batch").option("partitionOverwriteMode", "dynamic").parquet(sink)

    return requests.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def round_robin(df: DataFrame, servers: int) -> DataFrame:
    """Rows with the number of a server, dealt evenly within partitions without a shuffle; each partition begins at another server."""
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return df.withColumn("server", F.pmod(place + F.spark_partition_id(), F.lit(servers)))


def progress(query: StreamingQuery) -> dict:
    """Health: whether it runs, rows waiting and rates of the last batch."""
    last = query.lastProgress or {}
    return {"active": query.isActive, "status": query.status, "rows": last.get("numInputRows"), "rows_per_s": last.get("processedRowsPerSecond")}
