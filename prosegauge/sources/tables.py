"""Tables written once and read several times."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the folder that all executors share, spark.checkpoint.dir; a temporary folder only on a local master."""
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("prosegauge.shared.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="prosegauge-")
        spark.conf.set("prosegauge.shared.dir", at)
    path = f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
