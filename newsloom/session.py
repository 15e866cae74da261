"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

WORK_DIR_SETTING = "spark.checkpoint.dir"
_SHIPPED: set[str] = set()


def local_session(cores: str = "*", partitions: int = 8, app: str = "newsloom") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config(WORK_DIR_SETTING, tempfile.mkdtemp(prefix="newsloom-"))
        .config("spark.ui.showConsoleProgress", "false")
        # Without it every column expression records its Python call site.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application, for sessions that were not started with it.

    The archive is made beside the driver, which serves it to them; it holds code only.
    """
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        folder = tempfile.mkdtemp(prefix="newsloom-code-")
        package = os.path.dirname(os.path.abspath(__file__))
        archive = shutil.make_archive(f"{folder}/newsloom", "zip", os.path.dirname(package), os.path.basename(package))
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    `local_session` sets it. Another session without it may use a folder of this machine only if all its
    tasks run in this process.
    """
    root = spark.conf.get(WORK_DIR_SETTING, None)
    if not root:
        if spark.conf.get("spark.master", "").split("[")[0] != "local":
            raise ValueError(f"set {WORK_DIR_SETTING} to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="newsloom-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
