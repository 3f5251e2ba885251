"""Tables written once into the folder that all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where that is unset and all executors are threads of this
    process, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        root = _own.get(app) or _own.setdefault(app, tempfile.mkdtemp(prefix="gridtrack-"))
    return f"{root.rstrip('/')}/gridtrack-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with row numbers from 1 in an order that tells all rows apart: sorted by ranges, each in a task of its own,
    and moved by the sizes of the ranges before."""
    part = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = part.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(*order)
    out = part.withColumn(name, F.row_number().over(inside)).join(F.broadcast(sizes), "_part")  # a row for each range
    return out.withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_part", "_before")
