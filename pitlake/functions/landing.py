"""Cut lineage by landing a table as Parquet in the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder named by spark.checkpoint.dir.

    Only a local master, whose executors share the driver's disk, gets a folder of its own when none
    is set; on a cluster an unset folder is an error, since executors would write to their own disks.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-landing-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Spark's setting by which the shuffle files of a statement go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def land(df: DataFrame, label: str = "table") -> DataFrame:
    """Write once, read back. Survives executor loss, and later passes prune columns.

    The shuffle files of the write go with its end: nothing reads them again, and otherwise they stay on the executors' disks
    until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    found = spark.read.schema(df.schema).parquet(path)
    found.landed_at = path
    return found


def is_landed(df: DataFrame) -> bool:
    return "landed_at" in vars(df)


def discard(*landed: DataFrame) -> None:
    """Delete landed tables that nothing reads any more."""
    for df in landed:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.landed_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
