"""Session settings the jobs rely on, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
TASK_ROWS = 1 << 18  # rows that one task groups by key, more or less


def local_session(app: str = "maskaudit", cores: int | str = 8, partitions: int = 8) -> SparkSession:
    """Build a single-machine session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; fall back to a scratch folder in local mode only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    else:
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` on the shared checkpoint folder, so that lost executors do not change it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """Exchange ``df`` by ``keys`` into as many partitions as ``rows`` rows need; Spark merges partitions by their few bytes."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(partitions, rows // TASK_ROWS + 1), *keys)


class Rounds:
    """Tables of a job with repeated passes, in the shared checkpoint folder until they are dropped."""

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark = spark
        self.root = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
        self.written = 0
        self.kept: list[str] = []

    def put(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return it as read back."""
        self.written += 1
        path = f"{self.root}/{self.written}"
        df.write.parquet(path)
        self.kept.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def replace(self, df: DataFrame) -> DataFrame:
        """Write ``df``, drop every table written before, and return it as read back."""
        before, self.kept = self.kept, []
        out = self.put(df)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in before:
            place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)
        return out
