"""One place for session settings and for the folder of intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import SparkConf, SparkContext
from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one that spark.checkpoint.dir names. Only a local session, as in
    tests, may do without; it gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="riverlens-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df as a table of the shared folder: worked out once, and there for later stages whatever
    executors are lost."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def session(app: str = "riverlens", cores: int | None = None, **conf: str) -> SparkSession:
    """A session with these settings where nothing else is set. On a cluster the submitter's settings
    win; without a master (tests, benchmarks) it is a local one of `cores` threads."""
    cores = cores or os.cpu_count() or 8
    if "PYSPARK_GATEWAY_PORT" in os.environ:  # started by spark-submit: its settings are in the JVM
        SparkContext._ensure_initialized()
    given = SparkConf()
    ours = {
        "spark.app.name": app,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if not given.contains("spark.master"):
        ours |= {"spark.master": f"local[{cores}]", "spark.sql.shuffle.partitions": str(cores), "spark.driver.memory": "12g"}
    builder = SparkSession.builder
    for key, value in ({k: v for k, v in ours.items() if not given.contains(k)} | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
