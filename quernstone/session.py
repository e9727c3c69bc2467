"""The Spark session and the driver's tables as views."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

#: Tables of the star schema and the corpus, each ``<sf_dir>/<name>.parquet``.
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(cpus: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own and skips this."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName("quernstone")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables_of(spark: SparkSession, sf_dir: str) -> list[str]:
    """The names of all tables in a folder of any store that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    found = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(path)
    return sorted(n.removesuffix(".parquet") for n in (f.getPath().getName() for f in found) if n.endswith(".parquet"))


def register(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> None:
    """Temp views over the Parquet tables; scans stay lazy, so unused tables and columns cost nothing."""
    for name in names or TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
