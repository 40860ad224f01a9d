"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import json
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", partitions: int = 8, app: str = "benchlight") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the one the cluster names in ``spark.checkpoint.dir``.

    Only a session with a local master, as in tests, may do without that setting: it
    gets a local folder. Elsewhere the executors could not see one, so it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="benchlight-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


_scopes = threading.local()


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables that ``settle`` wrote inside it, in this thread.

    For work whose result is written or collected inside, such as a batch of a stream. A
    frame that is handed on reads its settled tables when it is used, so whoever uses it
    opens the scope. Scopes may be nested; each deletes its own.
    """
    outer, _scopes.paths = getattr(_scopes, "paths", None), []
    try:
        yield
    finally:
        paths, _scopes.paths = _scopes.paths, outer
        remove(spark, paths)


def settle(df: DataFrame) -> DataFrame:
    """The frame as a written table: computed once, read by column from then on.

    For a result several later passes read. It lives in the shared folder, so a lost
    executor costs a re-read and no recomputation, and its size is known to the
    planner, which decides by it what to broadcast. It stays until the scope it was made in
    ends (``intermediates``), and outside of one until the folder is cleared.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    if getattr(_scopes, "paths", None) is not None:
        _scopes.paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, paths: Sequence[str]) -> None:
    """Deletes files or folders, there or not."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def hold_splits(spark: SparkSession) -> None:
    """Has files cut alike by every later read of the session.

    Spark cuts files into splits by the cores it finds, which changes as executors come and
    go; the number it finds first is kept, where the session doesn't set one.
    """
    held = "spark.sql.files.minPartitionNum"
    if spark.conf.get(held, None) is None:
        spark.conf.set(held, str(spark.sparkContext.defaultParallelism))


def literal_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A handful of configuration rows as a constant of the plan; keys left out are NULL."""
    text = json.dumps(rows, default=str)
    parsed = F.from_json(F.lit(text), f"array<struct<{_as_struct(schema)}>>")
    return spark.range(1).select(F.inline(parsed))


def _as_struct(schema: str) -> str:
    """``name type, …`` spelled as the fields of a struct type."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).simpleString()[len("struct<") : -1]
