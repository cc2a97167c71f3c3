"""The folder that the driver and all executors share, and tables written to it."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, under which all intermediate tables go.

    Where the setting is missing, a local session (one machine, as in tests) makes a temporary folder and keeps to it;
    any other session is refused, as its executors would not see such a folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            folder = jdir.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            folder = "file://" + tempfile.mkdtemp(prefix="docmetrics-")
            spark.sparkContext.setCheckpointDir(folder)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{folder.rstrip('/')}/docmetrics"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def write_shared(spark: SparkSession, name: str, data: bytes) -> str:
    """Writes a small file to the shared folder; returns its path."""
    path = f"{shared_folder(spark)}/{name}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).create(jpath, True)
    try:
        for at in range(0, len(data), 1 << 20):
            out.write(bytearray(data[at : at + (1 << 20)]))
    finally:
        out.close()
    return path


#: Spark's own setting that drops a query's shuffle files once it has ended.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_lock = threading.Lock()
_writers: dict[SparkSession, tuple[int, str]] = {}  # how many threads write, and the setting before the first


@contextmanager
def _clean_up(spark: SparkSession) -> Iterator[None]:
    with _lock:
        n, before = _writers.get(spark, (0, ""))
        if not n:
            before = spark.conf.get(CLEAN_UP, "false")
            spark.conf.set(CLEAN_UP, "true")
        _writers[spark] = n + 1, before
    try:
        yield
    finally:
        with _lock:
            n, before = _writers.pop(spark)
            if n > 1:
                _writers[spark] = n - 1, before
            else:
                spark.conf.set(CLEAN_UP, before)


#: Narrow rows that one written file holds at least, where their number is known.
ROWS_A_FILE = 250_000


def _write(df: DataFrame, path: str, rows: int | None) -> None:
    if rows is not None and (tasks := max(8, -(-rows // ROWS_A_FILE))) < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        df.coalesce(tasks).write.parquet(path)
    else:
        df.write.parquet(path)


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends here and survives lost executors.

    ``rows``: a known bound on the number of narrow rows; few rows are then written by few tasks (eight or more), as each file costs
    more than its rows.

    Shuffle files of the finished write are dropped at once, so disk holds one step's shuffles at a time. The session's setting
    for that is on while any thread writes, and then as it was.
    """
    path = scratch(df.sparkSession, name)
    with _clean_up(df.sparkSession):
        _write(df, path, rows)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._docmetrics_path = path
    for made in getattr(_open, "made", ()):
        made.append(out)
    return out


_open = threading.local()


@contextmanager
def written_tables() -> Iterator[list[DataFrame]]:
    """The tables that this thread writes within the block, for ``discard`` once nothing reads them."""
    made: list[DataFrame] = []
    _open.made = [*getattr(_open, "made", ()), made]
    try:
        yield made
    finally:
        _open.made = [m for m in _open.made if m is not made]


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by ``materialize`` that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_docmetrics_path", None)
        if path:
            jvm = table.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
