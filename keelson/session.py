"""SparkSession construction with the settings every job relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "keelson") -> SparkSession:
    """Return (or create) a session configured for the keelson jobs.

    On a cluster the master, memory and ``spark.checkpoint.dir`` come from the
    submit configuration; the defaults here only matter for local runs/tests.
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Python call-site capture per Column call is a debugging aid; it costs a JVM
        # round trip per call when building wide plans on the driver.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Split a hot join key's partition even when that costs an extra shuffle.
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        # Small post-shuffle partitions are only coalesced down to this size, so CPU-heavy
        # stages keep every core busy on small inputs; irrelevant once partitions are large.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "256k")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if os.environ.get("KEELSON_EVENT_LOG_DIR"):  # profiling: stage / task times without the UI
        builder = (builder.config("spark.eventLog.enabled", "true")
                   .config("spark.eventLog.dir", os.environ["KEELSON_EVENT_LOG_DIR"])
                   .config("spark.eventLog.compress", "false"))
    if master or not os.environ.get("SPARK_MASTER"):
        builder = builder.master(master or f"local[{cpus}]")
        builder = builder.config("spark.driver.memory", "16g")
        if not shuffle_partitions:  # on a cluster the submit configuration decides
            builder = builder.config("spark.sql.shuffle.partitions", cpus)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


#: Bytecode of a method from which HotSpot never compiles it.
HOTSPOT_METHOD_LIMIT = 8000


def keep_methods_compiled(spark: SparkSession) -> None:
    """Have plans whose fused method HotSpot would interpret for ever run operator by operator, in small compiled methods.

    Spark fuses up to 64 KB; a wide rule stage makes one method of some 26 KB. Set where such stages are built, as the
    session may be the caller's; a lower limit stays."""
    key = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(key)) > HOTSPOT_METHOD_LIMIT:
        spark.conf.set(key, HOTSPOT_METHOD_LIMIT)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; set a scratch one only when unset (local runs)."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="keelson-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    spark.sparkContext.setCheckpointDir(current)
    return current
