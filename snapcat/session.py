"""Session settings the operators are written for."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Adaptive execution re-plans joins by measured size and splits skewed join partitions; UTC keeps wall clock and
# instants aligned for the epoch-second columns of the catalogs.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # no call-site capture per Column expression: it triples the round trips while a plan is built
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cpus: int = 8, app: str = "snapcat") -> SparkSession:
    """A single-machine session for tests and the benchmark; a cluster brings its own session."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names; a temporary one only where none is set, as in tests."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="snapcat-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder as a URI."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return base if ":/" in base else "file://" + base
