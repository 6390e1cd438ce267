"""Evaluating stored runs over the grid images: five runs, three of which have a reason to be refused."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskaudit.operators import metrics
from maskaudit.plans import evaluation
from workload.bindings import DATASET, FOLD_THRESHOLD_SQL, dice_sql, fold_threshold, grid_pixels, query, ratio_sql
from workload.images import EDGES, _tail
from workload.scoring import r9

# run, commit, dirty tree, finished
RUNS = [
    ("clean", "c1", False, True), ("dirty", "c0", True, True), ("moved", "c0", False, True), ("open", "c1", False, False),
    ("altered", "c1", False, True),
]
BINS = 10


def _runs(spark):
    config = '{"folds": {"n_folds": 5}}'
    return spark.createDataFrame(RUNS, "run_id string, git_commit string, git_dirty boolean, fin boolean").select(
        "run_id", "git_commit", "git_dirty", F.lit(config).alias("config"), F.lit("data").alias("data_hash"),
        F.when(F.col("fin"), "2026-01-01T00:00:00Z").alias("finished_at"),
    )


def _evaluation(spark, sf):
    truth = grid_pixels(spark, sf).select(
        F.lit(DATASET).alias("dataset"), F.col("image_id").cast("string").alias("image_id"), "row", "col", "label", "in_fov", "fold", "prob"
    )
    ids = F.explode(F.array(*[F.lit(r[0]) for r in RUNS])).alias("run_id")
    scored = truth.select(ids, "dataset", "image_id", "fold", "row", "col", "prob", "label", "in_fov")
    every = F.sequence(F.lit(1), F.lit(5))
    images = truth.select("dataset", "image_id", F.col("fold").alias("_own")).distinct()
    role = F.when(F.col("fold") == F.col("_own"), "test").when(F.col("fold") % 5 + 1 == F.col("_own"), "val").otherwise("train")
    assignments = (
        images.withColumn("fold", F.explode(every)).select(ids, "fold", "dataset", "image_id", role.alias("role"))
    )
    runs = _runs(spark)
    folds = runs.select("run_id", F.explode(every).alias("fold"))
    thresholds = folds.withColumn("threshold", fold_threshold())
    keys = ["run_id", "dataset", "image_id", "fold", "threshold"]
    kept = metrics.evaluate_items(evaluation.with_thresholds(scored, thresholds), keys, F.col("threshold"))
    odd = (F.col("run_id") == "altered") & (F.col("image_id").cast("bigint") % 20 == 7)
    none = F.lit(None).cast("double")
    stored = kept.select(
        "run_id", "dataset", "image_id", "fold", F.lit("single").alias("prediction_mode"),
        F.when(odd, F.col("dice") / 2).otherwise(F.col("dice")).alias("dice"),
        "sensitivity", "specificity", "precision_score", "accuracy", *[none.alias(c) for c in evaluation.FILLED],
    )
    t = {
        "runs": runs, "thresholds": thresholds, "fold_assignments": assignments, "per_image_metrics": stored,
        "fold_status": folds.withColumn("status", F.lit("complete")),
    }
    truth = truth.drop("fold", "prob")
    return evaluation.evaluate_runs(
        t, scored, truth, commit="c1", dirty=False, data_hash="data", bins=BINS, quantile=0.5
    )


HIT = f"cast(prob AS double) >= {FOLD_THRESHOLD_SQL}"
RECORDS = EDGES + f""",
hits AS (SELECT r.image_id, v.fold, r.d2, e.edge_d2, cast(v.prob AS double) >= (cast(v.fold * 5 + 30 AS double) / 100.0::double) AS hit
  FROM radii r JOIN vessel v USING (image_id, row, col) JOIN edges e ON e.fold = v.fold),
widths AS (SELECT image_id,
  {ratio_sql('count(*) FILTER (hit AND d2 <= edge_d2)', 'count(*) FILTER (d2 <= edge_d2)')} AS thin_sensitivity,
  {ratio_sql('count(*) FILTER (hit AND d2 > edge_d2)', 'count(*) FILTER (d2 > edge_d2)')} AS thick_sensitivity,
  count(*) FILTER (d2 <= edge_d2) AS n_thin, count(*) FILTER (d2 > edge_d2) AS n_thick FROM hits GROUP BY image_id),
tally AS (SELECT image_id, fold, count(*) FILTER (hit AND label) AS tp, count(*) FILTER (hit AND NOT label) AS fp,
  count(*) FILTER (NOT hit AND label) AS fn, count(*) FILTER (NOT hit AND NOT label) AS tn,
  avg(pow(cast(prob AS double) - cast(label AS integer), 2)) AS brier
  FROM (SELECT *, {HIT} AS hit FROM grid_pixels WHERE in_fov) GROUP BY ALL),
steps AS (SELECT image_id, prob, count(*) FILTER (label) AS n_pos, count(*) FILTER (NOT label) AS n_neg
  FROM grid_pixels WHERE in_fov GROUP BY ALL),
climb AS (SELECT *, sum(n_neg) OVER (PARTITION BY image_id ORDER BY prob) - n_neg AS neg_below,
  sum(n_pos) OVER (PARTITION BY image_id ORDER BY prob DESC) AS tp_at,
  sum(n_neg) OVER (PARTITION BY image_id ORDER BY prob DESC) AS fp_at FROM steps),
areas AS (SELECT image_id, cast(sum(n_pos * (2 * neg_below + n_neg)) AS double)
    / nullif(2.0::double * sum(n_pos) * sum(n_neg), 0) AS auc_roc,
  sum(cast(n_pos AS double) * (cast(tp_at AS double) / cast(tp_at + fp_at AS double))) / nullif(cast(sum(n_pos) AS double), 0) AS auc_pr
  FROM climb GROUP BY image_id),
accepted AS (SELECT * FROM (VALUES ('clean'), ('dirty')) v(run_id))"""


@query(
    "evaluate_run",
    _tail(
        "grid_pixels", RECORDS,
        f"""SELECT run_id, cast(image_id AS varchar) AS image_id, fold, {FOLD_THRESHOLD_SQL} AS threshold, {dice_sql('tp', 'fp', 'fn')} AS dice,
  round(auc_roc, 9) AS auc_roc, round(auc_pr, 9) AS auc_pr, round(brier, 9) AS brier, thin_sensitivity, thick_sensitivity
FROM tally JOIN areas USING (image_id) LEFT JOIN widths USING (image_id), accepted""",
    ),
)
def evaluate_run(spark, sf):
    """The metric rows of all runs that may be evaluated, filled, with the threshold that their fold chose."""
    e = _evaluation(spark, sf)
    filled = e.filled.join(e.folds.select("run_id", "fold", "threshold"), ["run_id", "fold"])
    columns = ["run_id", "image_id", "fold", "threshold", "dice", *evaluation.FILLED]
    return r9(filled.select(*columns), "auc_roc", "auc_pr", "brier")


@query(
    "evaluation_refusals",
    _tail(
        "grid_pixels", "odd AS (SELECT count(DISTINCT image_id) AS n FROM grid_pixels WHERE image_id % 20 = 7 AND in_fov)",
        """SELECT 'moved' AS run_id, 'other code' AS rule, 'trained at c0, evaluated at c1' AS detail
UNION ALL SELECT 'open', 'not finished', '1 reasons' UNION ALL SELECT 'altered', 'not reproduced', n || ' images' FROM odd""",
    ),
)
def evaluation_refusals(spark, sf):
    return _evaluation(spark, sf).refusals


@query(
    "evaluation_folds",
    _tail(
        "grid_pixels", RECORDS,
        f"""SELECT run_id, fold, {FOLD_THRESHOLD_SQL} AS threshold, sqrt(cast(max(edge_d2) AS double)) AS thin_edge,
  cast(sum(coalesce(n_thin, 0)) AS bigint) AS n_thin, cast(sum(coalesce(n_thick, 0)) AS bigint) AS n_thick
FROM tally LEFT JOIN widths USING (image_id) JOIN edges USING (fold), accepted GROUP BY run_id, fold""",
    ),
)
def evaluation_folds(spark, sf):
    return _evaluation(spark, sf).folds
