"""Session settings and the shared folder used for cut lineage and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# SQL settings the operators rely on; all can be changed on a live session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a hot document must be split even where that costs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # splits small enough that one file of long documents feeds several tasks
    "spark.sql.files.maxPartitionBytes": "32m",
    "spark.sql.files.openCostInBytes": "1m",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings above to a session somebody else built."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: str | int = "*", partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A single-JVM session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quire")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("quire.scan.partitions", str(partitions))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below the one named by ``spark.checkpoint.dir``.

    Every executor must reach it. Without the setting it lies in the warehouse,
    which executors share too; it is never a temporary folder of one machine.
    """
    conf = spark.sparkContext.getConf()
    named = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    base = named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    return f"{base}/quire-{spark.sparkContext.applicationId}"


def clean_shared(spark: SparkSession) -> None:
    """Delete what this application has written to ``shared_dir``; call it when all results are read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, with the session ``spark`` if given.

    A lost executor then costs a re-read, not the steps before; and a loop that
    does this each round keeps its plans from growing.
    """
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4()}"
    df.write.parquet(path)
    return (spark or df.sparkSession).read.parquet(path)
