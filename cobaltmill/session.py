"""Session, table and shared-folder helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_SHARED: dict[str, str] = {}
#: Whether a query deletes its shuffle files when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Keeps streaming state outside the heap.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def get_session(app: str = "cobaltmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; ``master`` is only for tests and the bench."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def computed_once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Add a costly column so that later steps reuse it instead of computing it again.

    Catalyst pushes filters on fields of a column down to where the column is computed and
    repeats it for every field; it does not push through a generator, here of one element.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the session.

    Only a local-mode session without the setting gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SHARED:
        _LOCAL_SHARED[app] = tempfile.mkdtemp(prefix="cobaltmill-")
    return _LOCAL_SHARED[app]


def own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/cobaltmill/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new, unused path under the shared folder."""
    return f"{own_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application.

    Results that still have to be read must be written elsewhere first.
    """
    remove_path(spark, own_folder(spark))


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of an earlier step, wherever the session keeps it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialise(df: DataFrame, tag: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written table.

    ``compression`` is that of the files, such as ``zstd`` for wide texts; the session's by default.

    Used where recomputation must not renumber rows, where lineage should end, and for the small
    side of a join with hot keys: a stored side has a known size, so it is broadcast when small,
    and when it is not, the adaptive planner can split hot keys (it cannot when an aggregate sits
    between the shuffle and the join).
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    with _shuffles_deleted(spark):
        df.write.parquet(path, compression=compression)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def discard(stored: DataFrame) -> None:
    """Delete a table that ``materialise`` wrote, once nothing that is still to run reads it."""
    remove_path(stored.sparkSession, stored.stored_at)


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Queries run inside delete their shuffle files at their end; only for what is never run again."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
