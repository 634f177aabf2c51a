"""Tables written once to the folder that all machines share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a temporary folder only for a local master without one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="timbrel-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/settled-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files behind a settled table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    root = scratch(spark)
    folders = {name.rsplit("/", 1)[0] for name in df.inputFiles()}
    for folder in folders:
        if "/settled-" in folder and root.split(":", 1)[-1].lstrip("/") in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
