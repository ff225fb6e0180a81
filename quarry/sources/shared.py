"""Tables written once to the folder that driver and executors share, so that they outlive lost executors and are the same each time they are read."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths that new_path() gave and that weren't removed since.
_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset and all runs on one machine, a new temporary one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file:{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder. Hadoop removes it when the application ends."""
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    _made.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Removes a file or folder of the shared folder."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that were written inside, once all that reads them is done."""
    first = len(_made)
    try:
        yield
    finally:
        for path in _made[first:]:
            remove(spark, path)
        del _made[first:]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written once to the shared folder: it cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, df: DataFrame) -> None:
    """Removes the files of a table made by written() that is no longer read."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(spark, path)
