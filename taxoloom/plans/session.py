"""Session settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Pin the two settings that change results or plans.

    Timestamps are handled as wall-clock values, so the session zone must be
    UTC wherever one is converted to an epoch. AQE coalesces small shuffle
    partitions and splits skewed ones at run time.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark
