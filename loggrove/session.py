"""Session settings the jobs rely on.

Nothing here sizes a cluster: partition counts and memory come from the
deployment. Only settings that change *results* or that every job needs are set.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The Java VM never compiles a method above 8,000 bytecodes. A stage whose generated
    # method is larger (many patterns per line) runs much faster operator by operator.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # The stateful operator keeps several values per key, which the default store cannot.
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "loggrove", **extra: str) -> SparkSession:
    """A single-JVM session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LOGGROVE_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in {**REQUIRED, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_settings(spark: SparkSession) -> SparkSession:
    """Apply the result-affecting settings to a session someone else built."""
    for key, value in REQUIRED.items():
        spark.conf.set(key, value)
    return spark
