"""Session defaults, table reading and durable stage tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, partitions: int = 8, app: str = "docuplane") -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("DOCUPLANE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers, once for each Spark application."""
    context = spark.sparkContext
    if getattr(context, "_docuplane_shipped", False):
        return
    root = Path(__file__).resolve().parent
    work = tempfile.mkdtemp(prefix="docuplane-package-")  # fetched by each executor when it starts, so it stays until the end
    atexit.register(shutil.rmtree, work, ignore_errors=True)
    shutil.copytree(root, f"{work}/tree/{root.name}", ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(f"{work}/{root.name}", "zip", f"{work}/tree"))
    context._docuplane_shipped = True


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    A cluster names it in ``spark.checkpoint.dir``; one that does not is refused. Only on
    one machine, as in tests, a temporary folder is made and recorded in the setting.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not (spark.sparkContext.master or "").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="docuplane-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def application_dir(spark: SparkSession) -> str:
    """This application's own part of the shared folder, deleted when it ends."""
    context = spark.sparkContext
    path = f"{shared_dir(spark)}/docuplane-{context.applicationId}"
    if getattr(context, "_docuplane_dir", None) != path:
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        files = target.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(target)
        files.deleteOnExit(target)
        context._docuplane_dir = path
    return path


def stage_table(df: DataFrame, name: str, partitions_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    Cuts the lineage, survives the loss of executors, and lets a stage that is read
    twice be computed once.
    """
    spark = df.sparkSession
    path = f"{application_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    if partitions_by:
        writer = writer.partitionBy(*partitions_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a query are deleted as soon as it has ended; else they
    stay until the driver happens to collect its garbage. For stage tables that are read
    from their files only."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)
