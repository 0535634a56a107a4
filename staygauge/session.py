"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FOLDERS: dict[str, str] = {}
_SHIPPED: set[str] = set()


def local_session(cores: str = "*", shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """Session for tests and the benchmark. A cluster brings its own session; nothing below depends on this one."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("staygauge")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # Small test tables still use all cores; on a cluster the defaults are right.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.files.openCostInBytes", "65536")
        .config("spark.ui.enabled", "false")
        # Else every column expression looks up its place in the source, which takes longer than small queries do.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that Python stages can import it there.

    Needed where only the driver has it on its path; a cluster that installs the package does not need to call this.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="staygauge-package-")) / "staygauge.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as zipped:
        for file in sorted(package.rglob("*.py")):
            zipped.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor can read: the cluster's ``spark.checkpoint.dir``.

    Only a local-mode session, where driver and executors are one process, gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors share.")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="staygauge-")
    return _LOCAL_FOLDERS[app]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/staygauge/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and gives the planner the measured size, so that it broadcasts the
    table only if it really is small. Used where a result is read more than once.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let the driver drop what finished steps left behind: plans, broadcasts, and the shuffles that wait for it.

    A step of many small jobs leaves little that is live, but the heap grows with the garbage instead of being collected, up to
    its limit, and is not given back. Meant for the end of such a step, as a collection takes a part of a second.
    """
    spark.sparkContext._jvm.System.gc()


def spread(df: DataFrame, *key: str, rows_per_task: int = 4096) -> DataFrame:
    """``df`` dealt by key over tasks of about ``rows_per_task`` rows, and over all cores at least.

    For narrow rows ahead of costly steps. The planner cuts files by bytes, so a million keys, each of which becomes a page,
    would be one task.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows_per_task))
    return df.repartition(tasks, *key)
