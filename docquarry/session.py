"""Session helpers that hold on a laptop and on a cluster alike."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

REPO = str(Path(__file__).resolve().parent.parent)


#: Allocator settings of Python workers: what a task frees goes back to the system, so that idle
#: workers don't hold an executor's memory. They were measured to halve what a worker keeps.
WORKER_MEMORY = {
    "ARROW_DEFAULT_MEMORY_POOL": "system",
    "MALLOC_MMAP_THRESHOLD_": str(4 << 20),
    "MALLOC_TRIM_THRESHOLD_": str(8 << 20),
    "MALLOC_ARENA_MAX": "2",
}


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when the driver found it by path, and free their memory.

    On a cluster the package comes with --py-files; the extra path is then harmless. Allocator
    settings of the session win.
    """
    env = spark.sparkContext.environment
    for key, value in WORKER_MEMORY.items():
        env.setdefault(key, value)
    parts = env.get("PYTHONPATH", "").split(os.pathsep) if env.get("PYTHONPATH") else []
    if REPO not in parts:
        env["PYTHONPATH"] = os.pathsep.join([REPO, *parts])
    return spark


def scratch(spark: SparkSession) -> str:
    """The shared folder for tables written between jobs.

    It is the session's spark.checkpoint.dir. Only where that is unset in local mode, as in tests, a
    folder under the warehouse is used; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"spark.checkpoint.dir is not set, and {master} needs a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _own(spark: SparkSession) -> str:
    return f"{scratch(spark)}/docquarry-{spark.sparkContext.applicationId}"


def path_exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def sweep(spark: SparkSession) -> None:
    """Remove all tables that this application wrote between jobs; call it when results are stored."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(_own(spark))
    path.getFileSystem(conf).delete(path, True)


def materialize(df: DataFrame, name: str = "step", rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors.

    rows: rows of a row group at most, for rows of megabytes. Tasks hold whole row groups, and Parquet
    looks at their size after 100 rows only.
    """
    spark = df.sparkSession
    path = f"{_own(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write if rows is None else df.write.option("parquet.block.row.count.limit", str(rows))
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def short_plans(spark: SparkSession, length: int = 4096) -> Iterator[None]:
    """Keep the plan texts that the driver stores of each job short, while many jobs of a loop run."""
    name = "spark.sql.maxPlanStringLength"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(length))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


#: What queries with transformWithState need of a session: state on disk, memory bounded for all stores of an executor.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",
}


@contextmanager
def session_with(spark: SparkSession, settings: dict[str, str] = STATE_STORE) -> Iterator[None]:
    """Settings of a session while queries are started; what was set before comes back."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables made by materialize()."""
    for df in tables:
        spark = df.sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def local_session(app: str = "docquarry", cores: str = "8") -> SparkSession:
    """A local session with the settings that tests and bench use."""
    return ship(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.warehouse.dir", "/tmp/docquarry-warehouse")
        .getOrCreate()
    )


def wider(schema: StructType, **fields: str) -> StructType:
    """A copy of a schema with more fields (a DataFrame's own schema object must not change)."""
    out = StructType(list(schema.fields))
    for name, kind in fields.items():
        out = out.add(StructType.fromDDL(f"`{name}` {kind}").fields[0])
    return out
