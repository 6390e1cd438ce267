"""Intermediate tables in the cluster's shared folder, so that lost executors do not change results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from maskaudit.session import ensure_checkpoint_dir


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: While a table is written: few megabytes go to Python together, whatever the length of texts, and the exchanges behind the
#: table go when it is there, not when the driver happens to collect its garbage.
WRITING = {
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


class Scratch:
    """A folder of Parquet tables below the session's checkpoint folder.

    A table written here cuts the lineage like a checkpoint does, but stays compressed and can be dropped as soon
    as the next round no longer reads it.
    """

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark = spark
        self.root = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
        self.n = 0

    def put(self, df: DataFrame, batch: int | None = None) -> DataFrame:
        """Write ``df`` and return it as read back; ``path_of`` remembers where it lies.

        ``batch`` bounds the rows that go to Python together, for plans whose rows are large.
        """
        self.n += 1
        path = f"{self.root}/{self.n}"
        conf = self.spark.conf
        held = WRITING | ({BATCH: str(batch)} if batch else {})
        before = {key: conf.get(key) for key in held}
        try:
            for key, value in held.items():
                conf.set(key, value)
            df.write.parquet(path)
        finally:
            for key, value in before.items():
                conf.set(key, value)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that ``put`` returned; no later plan may read it."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
