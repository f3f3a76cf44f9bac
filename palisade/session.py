"""Session settings the jobs rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# one meaning of time and of repeated header names everywhere
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


# rule scans work for seconds on a megabyte, so a task of Spark's own 128 MB would outlast all others
SPLIT_KEY, SPARKS_SPLIT, SPLIT_BYTES = "spark.sql.files.maxPartitionBytes", 128 << 20, 16 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Set what results depend on; sizes and parallelism stay the cluster's, but files are read in smaller splits unless it says how large."""
    for key, value in REQUIRED.items():
        spark.conf.set(key, value)
    if spark.conf.get(SPLIT_KEY).lower().removesuffix("b") in (str(SPARKS_SPLIT), "128m"):
        spark.conf.set(SPLIT_KEY, str(SPLIT_BYTES))
    return spark


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName("palisade")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)
