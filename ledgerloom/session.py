"""Session factory and table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "ledgerloom", cpus: int | None = None) -> SparkSession:
    """A UTC session with adaptive execution; shuffle partitions follow the cores locally."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    if cpus:
        builder = builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", str(cpus))
    return (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
