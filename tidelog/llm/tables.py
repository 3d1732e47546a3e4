"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, as in tests, a new temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage, computes ``df`` once for several readers and survives
    the loss of executors. Column names must differ from each other.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def without(df: DataFrame, ids: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` without the rows whose ``key`` is in ``ids`` (one column, written as table ``name``). Rows with a null key stay; ``df`` may have any columns."""
    own = f"_tl_{uuid.uuid4().hex}"
    return df.join(keep(ids.toDF(own), name), F.col(key) == F.col(own), "left_anti")
