"""Written tables that cut lineage between the steps of an iterative plan.

Everything goes to the shared folder named by ``spark.checkpoint.dir`` so the
data outlives the executors that wrote it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"


def staging_root(spark: SparkSession) -> str:
    root = spark.conf.get(_CONF, None) or spark.sparkContext.getConf().get(_CONF)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_CONF} to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="tempera-")
        spark.conf.set(_CONF, root)
    return root.rstrip("/")


def staged_path(spark: SparkSession, label: str) -> str:
    return f"{staging_root(spark)}/tempera/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def _place(spark: SparkSession, path: str):
    """A path and the Hadoop file system it belongs to."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    place, files = _place(spark, path)
    return files.exists(place)


def create_file(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file; false, and nothing changed, if there is one already."""
    place, files = _place(spark, path)
    if files.exists(place):
        return False
    out = files.create(place, False)
    out.write(bytearray(text.encode()))
    out.close()
    return True


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through the Hadoop file system it belongs to."""
    folder, files = _place(spark, path)
    files.delete(folder, True)


def release_staged(spark: SparkSession) -> None:
    """Delete every table this application staged; call it when no result depends on them any more."""
    delete_path(spark, f"{staging_root(spark)}/tempera/{spark.sparkContext.applicationId}")


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once as Parquet and return the table read back from it."""
    spark = df.sparkSession
    path = staged_path(spark, label)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
