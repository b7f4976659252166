"""Session helpers: local sessions for tests and staged tables for multi-pass jobs."""

from __future__ import annotations

import io
import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: dict[str, str] = {}
_SHIPPED: set[str] = set()


def local_session(cores: int = 8, name: str = "weftline", more: dict[str, str] | None = None) -> SparkSession:
    """Session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.config(map=more or {}).master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that jobs start from any folder."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = pathlib.Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent))
    folder = pathlib.Path(tempfile.mkdtemp(prefix="run-ship-"))
    (folder / f"{package.name}.zip").write_bytes(packed.getvalue())
    context.addPyFile(str(folder / f"{package.name}.zip"))
    _SHIPPED.add(context.applicationId)


def staging_root(spark: SparkSession) -> str:
    """Shared folder for staged tables, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster the
    executors do not share the driver's disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOT:
        _LOCAL_ROOT[app] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _LOCAL_ROOT[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    """New folder of this application; all of them lie under one parent that can be dropped afterwards."""
    return f"{staging_root(spark)}/weftline-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{label}"


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts lineage with a table that outlives lost executors, and keeps later
    passes column-pruned, unlike an RDD checkpoint.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give a small table one partition per core before heavy per-row work.

    ``df`` is a plain read of a table: asking for its partitions plans the scan
    and runs nothing. A scan of fewer partitions than cores is little data and
    costs little to move; larger ones keep their partitions.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


ROWS_A_TASK = 1 << 19


def spread_rows(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Partitions by key whose number follows the number of rows, so that the memory of a task does not."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // ROWS_A_TASK)), *keys)


def spread_pairs(df: DataFrame, *keys: str) -> DataFrame:
    """Even out rows that are few but costly, over a fixed number of partitions.

    Without a number adaptive execution would merge small rows into one task.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


TASKS_A_CORE = 8


def spread_waits(df: DataFrame) -> DataFrame:
    """Deal out rows of which some take very long, into so many tasks that a core with few of those goes on with the next task.

    Rows go round by round, so that keys that repeat do not meet in one task.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_A_CORE * spark.sparkContext.defaultParallelism))
