"""Session defaults and the lineage-cutting helper shared by the fixed-point jobs."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that hold at any size.  Partition counts are left to AQE coalescing on a cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int | str = "*", app: str = "plumbline", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    settings = {
        **DEFAULTS,
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A machine-local folder is only chosen for a local master, where driver and executors are one
    process; anywhere else a missing setting is an error, because a lost executor would take the
    checkpoint with it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):  # local-cluster[...] has executors of its own
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="spark-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and go on from the files: cuts lineage, survives executors.

    The files give the planner a size that was measured (a checkpoint keeps its plan's estimate, which overlooks what
    ``explode`` adds, so that large tables were broadcast) and can be deleted by ``release``.  They are packed lightly and
    without dictionaries: a broadcast is chosen by their size, and must still fit when unpacked.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "snappy").option("parquet.enable.dictionary", "false").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Free what finished steps left: written ``tables`` that nothing reads any more, and shuffle files.

    Spark drops the shuffle files of plans that the driver has collected as garbage, which it may put off for
    half an hour; between large steps the operators ask for it, so their steps' shuffles need not coexist.
    """
    for table in tables:
        path = getattr(table, "_kept_at", None)
        if path:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
