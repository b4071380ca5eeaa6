"""Tables that cut a job's lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a temporary one serves a local session; on a
    cluster, whose executors would each write to a disk of their own, that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not found:
        found = f"file://{tempfile.mkdtemp(prefix='echolode-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: whether shuffle files go when the job that made them ends, not when the driver happens to collect its garbage
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables that cut a job's lineage. They are Parquet in the shared folder, so they outlive executors. With ``tidy`` the
    shuffle files of a table's job go as soon as it is written."""

    def __init__(self, spark: SparkSession, tidy: bool = False) -> None:
        self.spark, self.tidy, self.root = spark, tidy, f"{shared_dir(spark)}/echolode-{uuid.uuid4().hex}"

    def cut(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        before = self.spark.conf.get(TIDY, "false")
        if self.tidy:
            self.spark.conf.set(TIDY, "true")
        try:
            df.write.mode("overwrite").option("compression", codec).parquet(f"{self.root}/{name}")
        finally:
            if self.tidy:
                self.spark.conf.set(TIDY, before)
        return self.read(df, name)

    def read(self, like: DataFrame, *names: str) -> DataFrame:
        """Written tables of the columns of ``like`` as one."""
        return self.spark.read.schema(like.schema).parquet(*(f"{self.root}/{name}" for name in names))

    def drop(self, *names: str) -> None:
        """Remove tables that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
