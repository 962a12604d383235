"""Sessions with the settings that the operators rely on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build(app: str = "strataform", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` keys use ``__`` for dots.

    On a cluster leave ``master`` unset: spark-submit gives it.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local(cpus: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks."""
    cpus = cpus or os.cpu_count() or 4
    spark = build(master=f"local[{cpus}]", spark__sql__shuffle__partitions=str(cpus), spark__driver__memory=memory, spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one in local sessions without it."""
    jsc = spark.sparkContext._jsc.sc()
    setting = spark.conf.get("spark.checkpoint.dir", None)
    if jsc.getCheckpointDir().isEmpty():
        if not setting and spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(setting or "file://" + tempfile.mkdtemp(prefix="strataform-"))
    return jsc.getCheckpointDir().get()
