"""Registry tables on Parquet: versioned schemas, appends, fold completion and snapshots."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, SparkRuntimeException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskaudit import schemas
from maskaudit.functions import scalars as S
from maskaudit.operators import audit, reconcile
from maskaudit.plans import reports


FOLD_TABLES = ("thresholds", "training_history", "per_image_metrics")


def table_schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(schemas.TABLES[name])


def table_path(root: str, name: str) -> str:
    return f"{root}/v{schemas.SCHEMA_VERSION}/{name}"


LAYOUT = "_layout"  # beside the data; a name that readers of the folder pass over


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def check_layout(spark: SparkSession, root: str, name: str, every_file: bool = False) -> None:
    """Refuse a stored table whose layout is not the declared one.

    The manifest beside the table, written with its first rows, must name this version and these columns; and the types
    in the Parquet footers must be the declared ones, in one file, or in ``every_file`` by a job over all footers.
    """
    path = table_path(root, name)
    if not _exists(spark, path):
        return
    if _exists(spark, f"{path}/{LAYOUT}"):
        stored = json.loads(spark.read.text(f"{path}/{LAYOUT}").first()["value"])
        if stored["version"] != schemas.SCHEMA_VERSION:
            raise ValueError(f"{name}: stored with layout version {stored['version']}, not {schemas.SCHEMA_VERSION}")
        if stored["columns"] != schemas.TABLES[name]:
            raise ValueError(f"{name}: stored with other columns than version {schemas.SCHEMA_VERSION} has")
    try:
        found = spark.read.option("mergeSchema", str(every_file).lower()).parquet(path).schema
    except AnalysisException as err:
        if "UNABLE_TO_INFER_SCHEMA" in str(err):  # no rows yet
            return
        raise
    except (SparkRuntimeException, Py4JJavaError) as err:
        raise ValueError(f"{name}: files of different layouts") from err
    wanted = {f.name: f.dataType for f in table_schema(name)}
    own = {f.name: f.dataType for f in found if f.name not in (*schemas.PARTITIONS.get(name, ()), "attempt")}
    odd = sorted(c for c in own if own[c] != wanted.get(c)) + sorted(
        c for c in wanted if c not in own and c not in schemas.PARTITIONS.get(name, ())
    )
    if odd:
        raise ValueError(f"{name}: the files hold another type or none for {odd}")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Read a table by its declared schema; another stored layout is refused."""
    check_layout(spark, root, name)
    return spark.read.schema(table_schema(name)).parquet(table_path(root, name))


# Types whose every value another type holds.
WIDER = {
    T.ByteType(): (T.ShortType(), T.IntegerType(), T.LongType()), T.ShortType(): (T.IntegerType(), T.LongType()),
    T.IntegerType(): (T.LongType(), T.DoubleType()), T.FloatType(): (T.DoubleType(),),
}


def conform(df: DataFrame, name: str) -> DataFrame:
    """Order and check the columns of a table: a missing or extra column, or a type that could lose values, is an error."""
    schema = table_schema(name)
    wanted, got = set(schema.names), set(df.columns)
    if wanted != got:
        raise ValueError(f"{name}: missing {sorted(wanted - got)}, unexpected {sorted(got - wanted)}")
    for f in schema:
        have = df.schema[f.name].dataType
        if have != f.dataType and not isinstance(have, T.NullType) and f.dataType not in WIDER.get(have, ()):
            raise ValueError(f"{name}: {f.name} is {have.simpleString()}, not {f.dataType.simpleString()}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def append(df: DataFrame, root: str, name: str) -> None:
    """Append rows that keep the declared layout, partitioned as declared."""
    _write(conform(df, name), root, name)


def append_new(df: DataFrame, root: str, name: str) -> int:
    """Append rows not stored yet and return how many.

    A differing stored row is an error, and so are incoming rows that differ under one key; equal ones count once.
    """
    spark = df.sparkSession
    stored = read_table(spark, root, name)
    incoming = conform(df, name).distinct()
    if not incoming.groupBy(*schemas.KEYS[name]).count().where("count > 1").isEmpty():
        raise ValueError(f"{name}: incoming rows of one key differ from each other")
    marked = reconcile.classify_upsert(incoming, stored, schemas.KEYS[name])
    counts = {r["status"]: r["count"] for r in marked.groupBy("status").count().collect()}
    if counts.get("conflict"):
        raise ValueError(f"{name}: {counts['conflict']} rows differ from the stored ones")
    append(marked.where("status = 'new'").drop("status"), root, name)
    return counts.get("new", 0)


def insert_runs(runs: DataFrame, verification: DataFrame, root: str) -> None:
    """Append runs, their config in canonical form and hashed; refused while the verification lists a problem."""
    if not verification.isEmpty():
        raise ValueError("the data does not match its manifest")
    text = reconcile.canonical_json(F.col("config"))
    append(runs.withColumn("config", text).withColumn("config_hash", F.sha2("config", 256)), root, "runs")


def complete_fold(
    tables: Mapping[str, DataFrame], status: DataFrame, root: str
) -> None:
    """Write a fold's thresholds, history and metrics, then its completion row last.

    The rows carry the number of their attempt, and readers go through ``read_visible``, which shows rows of the
    completed attempt only: what a lost job has written stays unseen, also after a retry.
    """
    if tables["training_history"].isEmpty():
        raise ValueError("a fold without training history cannot complete")
    current = audit.latest_status(read_table(status.sparkSession, root, "fold_status"))
    keys = status.select("run_id", "fold")
    running = current.where("status = 'running'")
    if not keys.join(running, ["run_id", "fold"], "left_anti").isEmpty():
        raise ValueError("only running folds can complete")
    attempt = status.select("run_id", "fold", F.col("attempts").cast("int").alias("attempt"))
    spark = status.sparkSession
    for name in FOLD_TABLES:
        # A job that was lost half way may have written rows of this attempt already: it has to start the fold again.
        if _exists(spark, table_path(root, name)):
            before = _attempts(spark, root, name).join(attempt, ["run_id", "fold", "attempt"], "left_semi")
            if not before.isEmpty():
                raise ValueError(f"{name}: this attempt has written rows before; start the fold again")
    for name in FOLD_TABLES:
        rows = conform(tables[name], name).join(attempt, ["run_id", "fold"])
        _write(rows.select(*table_schema(name).names, "attempt"), root, name)
    append(status, root, "fold_status")


def _write(rows: DataFrame, root: str, name: str) -> None:
    spark = rows.sparkSession
    check_layout(spark, root, name)
    layout = json.dumps({"version": schemas.SCHEMA_VERSION, "columns": schemas.TABLES[name]})
    if not _exists(spark, f"{table_path(root, name)}/{LAYOUT}"):
        spark.createDataFrame([(layout,)], "value string").coalesce(1).write.text(f"{table_path(root, name)}/{LAYOUT}")
    writer = rows.write.mode("append")
    if name in schemas.PARTITIONS:
        writer = writer.partitionBy(*schemas.PARTITIONS[name])
    writer.parquet(table_path(root, name))


def _attempts(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The rows of a fold table with the attempt that wrote them, NULL where none was recorded."""
    return spark.read.schema(table_schema(name).add("attempt", T.IntegerType())).parquet(table_path(root, name))


def read_visible(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The rows of a fold table that completed attempts have written."""
    statuses = audit.latest_status(read_table(spark, root, "fold_status"))
    return audit.rows_of_complete_folds(_attempts(spark, root, name), statuses).drop("attempt")


def start_folds(wanted: DataFrame, started_at: str, root: str) -> None:
    """Append a running row per fold with its attempt number; complete folds are an error."""
    current = audit.latest_status(read_table(wanted.sparkSession, root, "fold_status"))
    done = audit.complete_folds(current)
    if not wanted.join(done, ["run_id", "fold"], "left_semi").isEmpty():
        raise ValueError("a complete fold cannot start again")
    rows = audit.startable_folds(wanted, current).select(
        "run_id", "fold", F.lit("running").alias("status"),
        F.lit(None).cast("string").alias("checkpoint_sha256"), F.lit(started_at).alias("started_at"),
        F.lit(None).cast("string").alias("completed_at"), "attempts",
    )
    append(rows, root, "fold_status")


def write_evaluation(records: DataFrame, root: str, columns: Sequence[str]) -> None:
    """Fill evaluation columns of the runs in ``records``; all records must match or none is written.

    The runs' partitions are replaced as wholes, without what lost attempts left in them. The new rows are staged in a
    folder of their own beside the table first, since a job cannot overwrite what it reads.
    """
    spark = records.sparkSession
    name, keys = "per_image_metrics", schemas.KEYS["per_image_metrics"]
    runs = records.select("run_id").distinct()
    statuses = audit.latest_status(read_table(spark, root, "fold_status"))
    stored = audit.rows_of_complete_folds(_attempts(spark, root, name), statuses).join(runs, "run_id", "left_semi")
    if not reconcile.unfillable(stored, records, keys).isEmpty():
        raise ValueError("a record has no single stored row to fill")
    staged = f"{table_path(root, name)}_staged_{uuid.uuid4().hex}"
    filled = reconcile.fill_evaluation(stored, records, keys, columns)
    filled.select(*table_schema(name).names, "attempt").write.parquet(staged)
    (
        spark.read.schema(table_schema(name).add("attempt", T.IntegerType())).parquet(staged)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*schemas.PARTITIONS[name])
        .parquet(table_path(root, name))
    )


def save_scores(scored: DataFrame, root: str) -> None:
    """Store held-out scores, one folder per run and fold."""
    append(scored, root, "scored_pixels")


def score_digests(scored: DataFrame, width: Column) -> DataFrame:
    """The digest table that goes with saved scores."""
    position = F.col("row").cast("bigint") * width.cast("bigint") + F.col("col")
    return reconcile.score_digest(scored, ["run_id", "fold", "dataset", "image_id"], position)


def write_snapshot(tables: Mapping[str, DataFrame], out: str, tag: str) -> None:
    """Write the rows of reported runs to ``out/tag``; refuses any problem and never replaces."""
    spark = next(iter(tables.values())).sparkSession
    tag_ok = spark.range(1).select(S.is_release_tag(F.lit(tag))).first()[0]
    if not tag_ok:
        raise ValueError(f"{tag!r} is not a release tag")
    if tables["runs"].where("is_reported").isEmpty():
        raise ValueError("no reported runs")
    chosen = reports.snapshot(tables)
    if not reports.dangling_references(chosen).isEmpty():
        raise ValueError("the snapshot has dangling references")
    if not audit.leakage_audit(chosen["fold_assignments"]).isEmpty():
        raise ValueError("the leakage audit is not empty")
    for name, df in chosen.items():
        df.write.mode("errorifexists").parquet(f"{out}/{tag}/{name}")


def write_summary(summary: DataFrame, path: str) -> None:
    """One JSON line per run with its nested fold and reliability lists; an existing summary is never replaced."""
    summary.write.mode("errorifexists").json(path)


def read_summary(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Read a summary back by its declared schema."""
    return spark.read.schema(schema).json(path)
