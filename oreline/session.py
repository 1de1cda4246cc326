"""Session settings the operators rely on."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

# Split skewed join partitions also where that costs one more shuffle further up, for example
# between two joins on the same key.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A join whose smaller side turns out to have at most so much in every partition needs no sorting of the larger one.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    # Arithmetic that overflows stops instead of giving null.
    "spark.sql.ansi.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session somebody else built."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    scratch = tempfile.mkdtemp(prefix="oreline-")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("oreline")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", os.path.join(scratch, "warehouse"))
        .config("spark.driver.memory", os.environ.get("ORELINE_DRIVER_MEMORY", "8g"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder next to the checkpoints, which every executor reaches.

    It is removed when the driver's Python ends, if the session still runs then.
    """
    folder = f"{require_checkpoint_dir(spark)}/oreline-{name}-{uuid.uuid4().hex}"
    at_end(spark, lambda: remove_folder(spark, folder))
    return folder


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def at_end(spark: SparkSession, action: Callable[[], object]) -> None:
    """Run ``action`` when the driver's Python ends, unless the session has ended before."""

    def run() -> None:
        if spark.sparkContext._jsc is not None:
            with contextlib.suppress(Py4JError, PySparkException, OSError):
                action()

    atexit.register(run)


def require_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the session's own, as the cluster configured it.

    Only a local session without one gets a temporary folder; on a cluster such a folder would
    exist on one machine only.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = context.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="oreline-checkpoint-")
    context.setCheckpointDir(configured)
    return configured
