"""Stages of a plan written as tables, so that later stages start from data and not from a long lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Stages:
    """Parquet tables under one folder: the one given, else below ``spark.checkpoint.dir``, else a temporary one."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or f"file://{tempfile.gettempdir()}/tallymark"
        self.spark, self.root = spark, folder or f"{shared.rstrip('/')}/stages-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
