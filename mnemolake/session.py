"""Session settings and lineage cutting shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("mnemolake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a folder of our own only in local mode, where none is named (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get(CHECKPOINT_CONF) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local["):
            raise RuntimeError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="mnemolake-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def stored_path(spark: SparkSession, name: str = "") -> str:
    """A new path for a table of this application in the shared folder."""
    return f"{shared_dir(spark)}/mnemolake-{spark.sparkContext.applicationId}/{name}{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Compute once into a compressed table in the shared folder: cuts the lineage, survives the loss of executors,
    and later reads take only the columns they need.  `release` removes the tables of the application."""
    path = stored_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """The same as a table in buckets by key: a later join or aggregation by the key does not move it again.

    df should come from a shuffle by the key (it then already lies as the buckets do, and each bucket is one file)."""
    spark = df.sparkSession
    name = "stored_" + uuid.uuid4().hex
    df.write.bucketBy(partitions(spark), key).option("compression", "zstd").option("path", stored_path(spark)).format("parquet").saveAsTable(name)
    return spark.table(name)


def release(spark: SparkSession) -> None:
    """Remove the stored tables of this application; frames made from them can't be read any more."""
    for t in spark.catalog.listTables():
        if t.name.startswith("stored_"):
            spark.sql(f"DROP TABLE IF EXISTS {t.name}")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/mnemolake-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread_out(df) if spread else df


def spread_out(df: DataFrame) -> DataFrame:
    """A scan with fewer parts than cores (few, small files) is dealt out, for work that is heavy per row."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def once_per_id(df: DataFrame, key: str, *cols: str) -> DataFrame:
    """One row per key: of repeated rows the one with the smallest values. Rows with a null key are kept as one.

    A partial aggregate runs before the shuffle, so a key that holds many rows costs one row per task.
    """
    best = F.min(F.struct(*[F.col(c) for c in cols]))
    return df.groupBy(key).agg(best.alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])
