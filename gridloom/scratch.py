"""Scratch tables in the folder that a cluster shares, by which iterations cut their lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; without it a temporary folder for a local session, the warehouse for any other."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        local = spark.conf.get("spark.master", "local").split("[")[0] == "local"
        found = os.path.join(tempfile.gettempdir(), "checkpoints") if local else spark.conf.get("spark.sql.warehouse.dir")
    return found.rstrip("/") + "/gridloom"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df and read it back."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folders_of(df: DataFrame) -> set[str]:
    """The folders of files that df reads."""
    return {name.rsplit("/", 1)[0] for name in df.inputFiles()}


def drop_folders(spark: SparkSession, folders: set[str]) -> None:
    """Delete these folders, as far as they lie in the scratch folder."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    own = urlparse(scratch_dir(spark)).path.rstrip("/") + "/"
    for folder in folders:
        if urlparse(folder).path.startswith(own):
            path = hadoop.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
