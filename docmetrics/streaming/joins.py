"""Streams joined within an interval of event time, and files that come in turns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def follows(first: DataFrame, then: DataFrame, by: list[str], within: str, late: str, ts: str = "ts") -> DataFrame:
    """Pairs of rows with equal ``by`` in which ``then`` comes at the time of ``first`` or up to ``within`` later: (by..., l, r).

    For streams both sides have a watermark of ``late``; with the bounds on their distance each side's state is dropped once no row that is in time
    can meet it. Batches give the same pairs.
    """
    a = first.select(F.struct(*by).alias("_by"), F.struct("*").alias("l"), F.col(ts).alias("_from")).withWatermark("_from", late)
    b = then.select(F.struct(*by).alias("_to_by"), F.struct("*").alias("r"), F.col(ts).alias("_to")).withWatermark("_to", late)
    near = (F.col("_by") == F.col("_to_by")) & (F.col("_to") >= F.col("_from")) & (F.col("_to") <= F.col("_from") + F.expr(f"interval {within}"))
    return a.join(b, near).select(*(F.col(f"_by.{c}").alias(c) for c in by), "l", "r")


def run_in_turns(spark: SparkSession, turns: list[DataFrame], query: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """What a stream writes that reads ``turns`` one after another, in append mode, with state and watermark carried on between them.

    Each turn's files are added to the stream's source, and the query runs until it has read all there is; then it stops, and goes on from its
    checkpoint with the next. So files of a later turn come late, whatever their number. ``folder`` is on shared storage.
    """
    for turn in turns:
        turn.write.mode("append").parquet(f"{folder}/in")
        stream = query(spark.readStream.schema(turn.schema).parquet(f"{folder}/in"))
        run = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
        run.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
