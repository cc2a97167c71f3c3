"""Session helpers: sensible settings, and shipping the package to executors."""

from __future__ import annotations

import io
import os
import uuid
import zipfile

from pyspark.sql import SparkSession

from .shared import write_shared

#: Settings that hold at any size; sizes of partitions stay with the caller.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app: str = "docmetrics", master: str | None = None, **settings: str) -> SparkSession:
    """A session with ``SETTINGS`` whose workers can import the package; ``settings`` (dots written as double underscores) override them."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | {k.replace("__", "."): v for k, v in settings.items()})
    spark = (builder.master(master) if master else builder).getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors once per application, so that Python workers can import it anywhere."""
    context = spark.sparkContext
    if getattr(context, "_docmetrics_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(here)))
    context.addPyFile(write_shared(spark, f"package-{uuid.uuid4().hex}/docmetrics.zip", raw.getvalue()))
    context._docmetrics_shipped = True
