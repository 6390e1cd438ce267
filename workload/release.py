"""A registry in which some runs pass every rule: each customer is a run over the images that the nations stand for."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskaudit.operators import audit
from workload.bindings import DATASET, query, table

# A run breaks the rule of a divisor where the customer's number, counted up by the rule's place, is a multiple of it.
CHECKPOINT = "md5(concat(cast(k AS string), '/', cast(fold AS string)))"


def _tables(spark, sf):
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    nations = table(spark, sf, "nation").agg(F.sort_array(F.collect_list("n_nationkey")).alias("all"))
    name = F.concat(F.lit("r"), F.col("k").cast("string")).alias("run_id")
    runs = customers.select(
        name, F.lit("baseline").alias("variant"),
        F.lit('{"folds": {"n_folds": 2}, "training": {"deterministic_ops": true}}').alias("config"),
        F.concat(F.lit("c"), (F.col("k") % 9).cast("string")).alias("git_commit"),
        ((F.col("k") + 1) % 7 == 0).alias("git_dirty"), F.when((F.col("k") + 2) % 8 != 0, "v1.0.0").alias("git_tag"),
        F.when((F.col("k") + 3) % 9 == 0, "old").otherwise("now").alias("data_hash"),
        F.when((F.col("k") + 4) % 10 == 0, "cpu").otherwise("Tesla T4").alias("gpu_type"), F.lit("colab").alias("compute_platform"),
        ((F.col("k") + 5) % 11 != 0).alias("deterministic_ops"),
        F.when((F.col("k") + 6) % 12 != 0, "2026-01-01T00:00:00Z").alias("finished_at"),
    )
    folds = customers.select("k", F.explode(F.array(F.lit(1), F.lit(2))).alias("fold"))
    statuses = folds.select(
        name, "fold", F.when((F.col("k") + F.col("fold")) % 13 == 0, "running").otherwise("complete").alias("status"),
        F.expr(CHECKPOINT).alias("checkpoint_sha256"),
    )
    artifacts = folds.select(name, "fold", F.when((F.col("k") + F.col("fold")) % 14 == 0, "lost").otherwise(F.expr(CHECKPOINT)).alias("digest"))
    image = F.concat(F.lit("i"), F.col("i").cast("string")).alias("image_id")
    pairs = customers.select("k", F.explode(nations.scalar()).alias("i"))
    role = F.when(F.col("fold") == F.col("i") % 2 + 1, "test").otherwise("train")
    # Now and then an image is not tested at all, or tested by both folds.
    missed, leaked = (F.col("k") + F.col("i")) % 211 == 0, (F.col("k") + F.col("i")) % 223 == 0
    assignments = pairs.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("fold")).select(
        name, "fold", F.lit(DATASET).alias("dataset"), image,
        F.when(missed, "train").when(leaked, "test").otherwise(role).alias("role"),
    )
    metrics = pairs.select(
        name, F.lit(DATASET).alias("dataset"), image, F.lit("single").alias("prediction_mode"),
        F.when((F.col("k") + F.col("i")) % 227 != 0, F.lit(0.25)).alias("brier"),
    )
    images = table(spark, sf, "nation").select(
        F.lit(DATASET).alias("dataset"), F.concat(F.lit("i"), F.col("n_nationkey").cast("string")).alias("image_id"),
        (F.col("n_nationkey") % 5 != 0).alias("has_labels"),
    )
    evaluations = customers.select(
        name, F.concat(F.lit("c"), ((F.col("k") + F.when(F.col("k") % 15 == 0, 1).otherwise(0)) % 9).cast("string")).alias("commit"),
        (F.col("k") % 16 == 0).alias("dirty"),
    )
    verified = customers.select(F.lit(DATASET).alias("dataset"), F.lit("now").alias("data_hash")).distinct()
    return runs, audit.reportability(
        runs, statuses, assignments, metrics, images, evaluations, artifacts, verified, gpu_type="Tesla T4", platform="colab"
    )


PROBLEMS = """c AS MATERIALIZED (SELECT c_custkey AS k FROM customer),
pairs AS MATERIALIZED (SELECT k, n_nationkey AS i FROM c, nation),
problems AS MATERIALIZED (
  SELECT k, 'dirty tree' AS rule FROM c WHERE (k + 1) % 7 = 0 UNION ALL SELECT k, 'no tag' FROM c WHERE (k + 2) % 8 = 0
  UNION ALL SELECT k, 'data hash' FROM c WHERE (k + 3) % 9 = 0 UNION ALL SELECT k, 'hardware' FROM c WHERE (k + 4) % 10 = 0
  UNION ALL SELECT k, 'determinism' FROM c WHERE (k + 5) % 11 = 0
  UNION ALL SELECT k, 'unfinished' FROM c WHERE (k + 6) % 12 = 0 OR (k + 1) % 13 = 0 OR (k + 2) % 13 = 0
  UNION ALL SELECT k, 'checkpoint' FROM c, (VALUES (1), (2)) f(fold) WHERE (k + fold) % 14 = 0 AND (k + fold) % 13 <> 0
  UNION ALL SELECT DISTINCT k, 'never tested' FROM pairs WHERE (k + i) % 211 = 0 AND i % 5 <> 0
  UNION ALL SELECT DISTINCT k, 'leakage' FROM pairs WHERE (k + i) % 223 = 0 AND (k + i) % 211 <> 0
  UNION ALL SELECT DISTINCT k, 'rows for untested' FROM pairs WHERE (k + i) % 211 = 0
  UNION ALL SELECT DISTINCT k, 'partly evaluated' FROM pairs WHERE (k + i) % 227 = 0 AND (k + i) % 211 <> 0
  UNION ALL SELECT k, 'evaluation' FROM c WHERE k % 15 = 0 OR k % 16 = 0)"""


@query("release_rules", f"WITH {PROBLEMS}\nSELECT 'r' || k AS run_id, rule FROM problems")
def release_rules(spark, sf):
    """Every rule that every run breaks."""
    return _tables(spark, sf)[1].select("run_id", "rule")


@query(
    "release_runs",
    f"WITH {PROBLEMS}\nSELECT 'r' || k AS run_id, true AS is_reported FROM c WHERE k NOT IN (SELECT k FROM problems)",
)
def release_runs(spark, sf):
    """The runs that pass all twelve rules, marked as reported; none is waived."""
    runs, problems = _tables(spark, sf)
    return audit.mark_reportable(runs, problems).select("run_id", "is_reported")
