"""The session that queries expect."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "docsignal", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for k, v in (CONF | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint, in spark.checkpoint.dir; where that is unset, as in tests, in a temporary folder."""
    spark = df.sparkSession
    if not (spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="docsignal-"))
    return df.checkpoint()
