"""Session settings, shared scratch space and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per session: functions that run there are pickled by reference to it.

    The archive lies on the driver, from where Spark serves it until the session ends.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tarn-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def build_session(app: str = "tarn", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators count on; ``conf`` overrides them."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local master, where driver and executors are one machine, may fall back to a temporary folder.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    made = tempfile.mkdtemp(prefix="tarn-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder, so a lost executor costs a re-read and not a replay of all rounds."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def on_demand(df: DataFrame) -> DataFrame:
    """``df`` by its rows alone, for results too large to store: shuffles below them run now, the rows are worked out when they are asked for
    (again for every action), and what is built upon them doesn't plan them anew."""
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(df._jdf.toJavaRDD(), df._jdf.schema()), spark)


#: Paths of the tables stored inside the innermost ``temporary`` block.
_STORED: ContextVar[list[str] | None] = ContextVar("stored", default=None)


#: Tasks that write a table inside the innermost ``few_tasks`` block, at most.
_TASKS: ContextVar[int | None] = ContextVar("tasks", default=None)
#: Rows for which a task is worth while, whatever the session's number of shuffle partitions.
TASK_ROWS = 2500


@contextmanager
def few_tasks(spark: SparkSession, rows: int) -> Iterator[None]:
    """A block whose tables follow from ``rows`` rows: ``gathered`` and stored tables have no more tasks than these are worth.

    Many shuffle partitions for few rows cost a task and a file each. Three rounds of tasks for all cores there may be in any case.
    """
    token = _TASKS.set(max(3 * spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))
    try:
        yield
    finally:
        _TASKS.reset(token)


def gathered(df: DataFrame) -> DataFrame:
    """``df`` in no more partitions than the ``few_tasks`` block around gives it, without a shuffle; elsewhere as it is."""
    return df if _TASKS.get() is None else df.coalesce(_TASKS.get())


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """A block whose stored tables hand Python tasks at most ``rows`` rows at a time, for rows that hold whole texts or sets."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _written(df: DataFrame, paths: list[str] | None) -> DataFrame:
    path = scratch_path(df.sparkSession, "stored")
    if paths is not None:
        paths.append(path)
    gathered(df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store(df: DataFrame) -> DataFrame:
    """Write a large table once to the shared folder and read it back: like a checkpoint, but columnar,
    with column pruning and with sizes the planner knows."""
    return _written(df, _STORED.get())


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A block whose stored tables are deleted at its end.

    It gives a function that stores a table for longer: until the end of the block around this one, or for good if there is none.
    Whatever leaves the block must rest on tables stored so.
    """
    outer, paths = _STORED.get(), []
    token = _STORED.set(paths)
    try:
        yield lambda df: _written(df, outer)
    finally:
        _STORED.reset(token)
        for path in map(spark._jvm.org.apache.hadoop.fs.Path, paths):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
