"""Queries over the run registry: stored queries, audits, data quality, checksums and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskaudit import schemas
from maskaudit.functions import scalars as S
from maskaudit.operators import audit, quality, reconcile, stats
from maskaudit.plans import queries as stored
from maskaudit.plans import reports
from workload import bindings as B
from workload.bindings import DATASET, query, sql, table
from workload.images import WIDTHS, grid_widths
from workload.scoring import SPREAD, SPREAD_COLUMNS, _with, bootstrap_sql, long_sql, r9

# ---------------------------------------------------------------- the five stored queries

MEANS_SQL = ",\n  ".join(f"round(avg(m.{m}), 9) AS {name}" for name, m in stored.FOLD_MEANS.items())


@query(
    "fold_summary",
    sql(
        f"""SELECT r.run_id, r.variant, r.is_reported, m.fold, count(*) AS n_images, count(m.brier) AS n_evaluated,
  {MEANS_SQL}
FROM metrics m JOIN eval_runs r ON m.run_id = r.run_id
WHERE m.dataset = 'drive' AND m.prediction_mode = 'single' AND m.fold IS NOT NULL AND r.finished_at IS NOT NULL
GROUP BY r.run_id, r.variant, r.is_reported, m.fold""",
        "metrics", "eval_runs",
    ),
)
def fold_summary(spark, sf):
    return r9(stored.run_query(B.eval_tables(spark, sf), "01_fold_summary"), *stored.FOLD_MEANS)


@query(
    "worst_images",
    sql(
        """SELECT r.run_id, r.variant, r.is_reported, m.image_id, m.fold, i.has_abnormality, m.dice, m.sensitivity,
  m.precision_score, m.thin_sensitivity, m.thick_sensitivity,
  row_number() OVER (PARTITION BY m.run_id ORDER BY m.dice NULLS FIRST, m.image_id) AS dice_rank
FROM metrics m JOIN eval_runs r ON m.run_id = r.run_id
JOIN eval_images i ON m.dataset = i.dataset AND m.image_id = i.image_id
WHERE m.dataset = 'drive' AND m.prediction_mode = 'single' AND m.fold IS NOT NULL AND r.finished_at IS NOT NULL""",
        "metrics", "eval_runs", "eval_images",
    ),
)
def worst_images(spark, sf):
    return stored.run_query(B.eval_tables(spark, sf), "02_worst_images")


# Each run's assignments as one sorted list, so two runs share folds when their lists are equal.
PAIRS_CTE = """held AS (SELECT run_id, list_sort(list(DISTINCT concat_ws('/', fold, image_id, role))) AS folds
  FROM eval_assignments GROUP BY run_id),
done AS (SELECT e.*, coalesce(folds, []) AS folds FROM eval_runs e LEFT JOIN held USING (run_id) WHERE finished_at IS NOT NULL),
pairs AS (SELECT one.run_id AS baseline_run_id, two.run_id AS other_run_id, two.variant AS other_variant,
  one.is_reported AS baseline_is_reported, two.is_reported AS other_is_reported
  FROM done one JOIN done two USING (data_hash, folds) WHERE one.variant = 'baseline' AND two.variant <> 'baseline')"""
DELTAS_SQL = ", ".join(f"round(o.{m} - b.{m}, 9) AS {name}" for name, m in stored.DELTAS.items())


@query(
    "variant_comparison",
    _with(
        "metrics", PAIRS_CTE,
        f"""SELECT p.*, b.image_id, b.fold, {DELTAS_SQL}
FROM pairs p JOIN metrics b ON b.run_id = p.baseline_run_id JOIN metrics o ON o.run_id = p.other_run_id
  AND b.dataset = o.dataset AND b.image_id = o.image_id AND b.prediction_mode = o.prediction_mode
WHERE b.dataset = 'drive' AND b.prediction_mode = 'single'""",
        "metrics", "eval_runs", "eval_assignments",
    ),
)
def variant_comparison(spark, sf):
    return r9(stored.run_query(B.eval_tables(spark, sf), "03_variant_comparison"), *stored.DELTAS)


@query(
    "identical_fold_pairs",
    _with("", PAIRS_CTE, "SELECT * FROM pairs", "eval_runs", "eval_assignments"),
)
def identical_fold_pairs(spark, sf):
    return stored.paired_runs(
        {"runs": B.eval_runs(spark, sf), "fold_assignments": B.eval_assignments(spark, sf)}
    )


LEAKS = """leaks AS (SELECT run_id, dataset, image_id, 'more than one role in fold ' || fold AS problem,
  string_agg(DISTINCT role, ',' ORDER BY role) AS detail
  FROM reg_assignments GROUP BY run_id, fold, dataset, image_id HAVING count(DISTINCT role) > 1
  UNION ALL SELECT run_id, dataset, image_id, 'test in more than one fold',
  array_to_string(list_sort(list(DISTINCT fold)), ',')
  FROM reg_assignments WHERE role = 'test' GROUP BY run_id, dataset, image_id HAVING count(DISTINCT fold) > 1)"""


@query("leakage_audit", _with("", LEAKS, "SELECT * FROM leaks", "reg_assignments"))
def leakage_audit(spark, sf):
    return stored.run_query({"fold_assignments": B.reg_assignments(spark, sf)}, "04_leakage_audit")


@query("threshold_log", sql("SELECT * FROM threshold_log", "threshold_log"))
def threshold_log(spark, sf):
    return stored.run_query(B.history_tables(spark, sf), "05_threshold_log")


# ---------------------------------------------------------------- training history


@query(
    "training_history_marked",
    sql(
        """SELECT h.run_id, h.fold, h.epoch, h.train_loss, h.val_dice, coalesce(h.epoch = t.best_epoch, false) AS is_best
FROM history h LEFT JOIN threshold_log t ON t.run_id = h.run_id AND t.fold = h.fold""",
        "threshold_log",
    ),
)
def training_history_marked(spark, sf):
    return reports.marked_history(B.history_tables(spark, sf))


@query(
    "early_stop_trace",
    _with(
        "",
        """step AS (SELECT run_id, fold, epoch, val_dice,
  coalesce(val_dice > coalesce(max(val_dice) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1), false)
    AS improved, row_number() OVER w AS i FROM history WINDOW w AS (PARTITION BY run_id, fold ORDER BY epoch)),
since AS (SELECT *, i - coalesce(max(CASE WHEN improved THEN i END) OVER (PARTITION BY run_id, fold ORDER BY epoch), 0)
    AS since_best FROM step)""",
        """SELECT run_id, fold, epoch, val_dice, improved, since_best, since_best >= 5 AS stop,
  coalesce(max(CASE WHEN since_best >= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, fold ORDER BY epoch
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS trained FROM since""",
        "history",
    ),
)
def early_stop_trace(spark, sf):
    return audit.early_stop_trace(B.history(spark, sf), 5)


# ---------------------------------------------------------------- reports


def _ci_report(metrics, extra: str = "", columns: str = "") -> str:
    return _with(
        "metrics",
        long_sql(metrics) + ",\n" + bootstrap_sql(reports.SEED, reports.RESAMPLES, reports.LEVEL)
        + f",\nspread AS (SELECT run_id, metric, {SPREAD} FROM long GROUP BY ALL)" + extra,
        f"SELECT s.*, c.ci_low, c.ci_high{columns} FROM spread s JOIN ci c USING (run_id, metric)",
        "metrics", "eval_images",
    )


@query(
    "report_headline",
    _ci_report(
        reports.HEADLINE,
        """,
majority AS (SELECT m.run_id, round(avg(1.0::double - i.vessel_fraction_in_fov), 9) AS majority_accuracy
  FROM metrics m JOIN eval_images i USING (dataset, image_id) GROUP BY m.run_id)""",
        ", j.majority_accuracy",
    ) + " JOIN majority j USING (run_id)",
)
def report_headline(spark, sf):
    out = reports.headline(B.eval_tables(spark, sf), DATASET)
    return r9(out, *SPREAD_COLUMNS, "ci_low", "ci_high", "majority_accuracy")


@query("width_summary", _ci_report(reports.WIDTHS))
def width_summary(spark, sf):
    out = reports.width_summary(B.eval_tables(spark, sf), DATASET)
    return r9(out, *SPREAD_COLUMNS, "ci_low", "ci_high")


@query(
    "majority_accuracy",
    sql(
        """SELECT dataset, round(avg(1.0::double - vessel_fraction_in_fov), 9) AS majority_accuracy
FROM eval_images GROUP BY dataset""",
        "eval_images",
    ),
)
def majority_accuracy(spark, sf):
    out = stats.majority_accuracy(B.eval_images(spark, sf), ["dataset"], "vessel_fraction_in_fov")
    return r9(out, "majority_accuracy")


FRACTION = "cast(positive_pixels AS double) / cast(fov_pixels AS double)"


@query(
    "dataset_stats",
    sql(
        f"""SELECT dataset, count(*) AS n_images, cast(sum(positive_pixels) AS double) / cast(sum(fov_pixels) AS double)
  AS pooled_fraction, min({FRACTION}) AS min_fraction, max({FRACTION}) AS max_fraction
FROM eval_images WHERE positive_pixels IS NOT NULL GROUP BY dataset""",
        "eval_images",
    ),
)
def dataset_stats(spark, sf):
    return stats.dataset_stats(B.eval_images(spark, sf), ["dataset"])


@query(
    "subgroup_summary",
    _with(
        "metrics",
        """flagged AS (SELECT m.run_id, m.image_id, i.has_abnormality, dice, sensitivity, auc_pr
  FROM metrics m JOIN eval_images i USING (dataset, image_id)),
long AS (SELECT run_id, has_abnormality, metric, value FROM (UNPIVOT flagged ON dice, sensitivity, auc_pr
  INTO NAME metric VALUE value))""",
        """SELECT run_id, metric, has_abnormality, count(*) AS n, round(min(value), 9) AS minimum,
  round(max(value), 9) AS maximum, round(quantile_cont(value, 0.5), 9) AS median FROM long GROUP BY ALL""",
        "metrics", "eval_images",
    ),
)
def subgroup_summary(spark, sf):
    out = reports.subgroup(B.eval_tables(spark, sf), DATASET)
    return r9(out, "minimum", "maximum", "median")


PER_IMAGE = [c for c in reports.HEADLINE if c != "accuracy"] + list(reports.WIDTHS)
ROUNDED = ("auc_roc", "auc_pr", "brier")


@query(
    "report_per_image",
    sql(
        "SELECT m.run_id, m.image_id, m.fold, i.has_abnormality, "
        + ", ".join(f"round(m.{c}, 9) AS {c}" if c in ROUNDED else f"m.{c}" for c in PER_IMAGE)
        + " FROM metrics m JOIN eval_images i USING (dataset, image_id)",
        "metrics", "eval_images",
    ),
)
def report_per_image(spark, sf):
    return r9(reports.per_image(B.eval_tables(spark, sf), DATASET), *ROUNDED)


def _history_with_images(spark, sf):
    """Training history tables with the customers of each run and fold as its test images."""
    t = B.history_tables(spark, sf)
    tested = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("run_id"),
        (F.col("o_custkey") % 5 + 1).cast("int").alias("fold"),
        F.lit(DATASET).alias("dataset"), F.lit("single").alias("prediction_mode"),
        F.col("o_custkey").cast("string").alias("image_id"),
    ).distinct()
    return {**t, "per_image_metrics": tested}


@query(
    "report_per_fold",
    sql("", "grid_pixels", "threshold_log").rstrip() + ",\n" + WIDTHS + """,
totals AS (SELECT fold, cast(sum(n_thin) AS bigint) AS n_thin, cast(sum(n_thick) AS bigint) AS n_thick
  FROM widths GROUP BY fold),
tests AS (SELECT o_orderpriority AS run_id, o_custkey % 5 + 1 AS fold, count(DISTINCT o_custkey) AS n_test,
  min(cast(o_custkey AS varchar)) AS first_test, max(cast(o_custkey AS varchar)) AS last_test FROM orders GROUP BY ALL)
SELECT l.run_id, l.fold, threshold, selection_rule, val_dice, best_epoch, n_epochs, n_test, first_test, last_test,
  sqrt(cast(edge_d2 AS double)) AS thin_edge, n_thin, n_thick
FROM threshold_log l LEFT JOIN tests t ON t.run_id = l.run_id AND t.fold = l.fold
LEFT JOIN edges e ON e.fold = l.fold LEFT JOIN totals w ON w.fold = l.fold""",
)
def report_per_fold(spark, sf):
    widths, edges = grid_widths(spark, sf)
    per_fold = edges.join(
        widths.groupBy("fold").agg(F.sum("n_thin").alias("n_thin"), F.sum("n_thick").alias("n_thick")), "fold"
    ).drop("edge_d2")
    t = _history_with_images(spark, sf)
    return reports.per_fold(t, DATASET, t["runs"].select("run_id").distinct().join(
        t["thresholds"].select("run_id", "fold"), "run_id").join(per_fold, "fold"))


@query(
    "report_fold_test_images",
    sql("SELECT DISTINCT run_id, fold, image_id FROM metrics WHERE prediction_mode = 'single'", "metrics"),
)
def report_fold_test_images(spark, sf):
    return reports.fold_test_images(B.eval_tables(spark, sf), DATASET)


def _provenance_sql() -> str:
    wide = """wide AS (SELECT r.run_id, variant, git_tag, git_commit, CASE WHEN git_dirty THEN 'no' ELSE 'yes' END AS trained_clean,
  e.commit AS evaluated_commit, CASE WHEN e.dirty THEN 'no' WHEN NOT e.dirty THEN 'yes' END AS evaluated_clean, data_hash,
  cast(coalesce(k.n, 0) AS varchar) AS leak_rows, gpu_type, compute_platform, python_version, tensorflow_version,
  cuda_version, CASE WHEN deterministic_ops THEN 'yes' ELSE 'no' END AS deterministic_ops, started_at, finished_at,
  cast(cast(round_even(date_diff('second', try_strptime(started_at, '%Y-%m-%dT%H:%M:%SZ'),
    try_strptime(finished_at, '%Y-%m-%dT%H:%M:%SZ')) / 60.0::double, 0) AS bigint) AS varchar) AS minutes
  FROM reg_runs r LEFT JOIN reg_evaluations e USING (run_id)
  LEFT JOIN (SELECT run_id, count(*) AS n FROM leaks GROUP BY 1) k USING (run_id) WHERE finished_at IS NOT NULL)"""
    return _with(
        "", LEAKS + ",\n" + wide,
        "SELECT run_id, field, value FROM wide UNPIVOT INCLUDE NULLS (value FOR field IN ("
        + ", ".join(reports.PROVENANCE) + "))",
        "reg_runs", "reg_assignments", "reg_evaluations",
    )


@query("report_provenance", _provenance_sql())
def report_provenance(spark, sf):
    t = {"runs": B.reg_runs(spark, sf), "fold_assignments": B.reg_assignments(spark, sf)}
    return reports.provenance(t, B.reg_evaluations(spark, sf))


@query(
    "chart_strip",
    _with(
        "metrics",
        """flagged AS (SELECT m.run_id, m.image_id, i.has_abnormality, thin_sensitivity, thick_sensitivity
  FROM metrics m JOIN eval_images i USING (dataset, image_id)),
long AS (SELECT * FROM (UNPIVOT flagged ON thin_sensitivity, thick_sensitivity INTO NAME metric VALUE value))""",
        """SELECT run_id, metric, image_id, has_abnormality, value, round(-0.15::double + 0.3::double
  * (row_number() OVER (PARTITION BY run_id, metric ORDER BY image_id) - 1)
  / greatest(count(*) OVER (PARTITION BY run_id, metric) - 1, 1), 9) AS offset FROM long""",
        "metrics", "eval_images",
    ),
)
def chart_strip(spark, sf):
    return r9(reports.chart_strip(B.eval_tables(spark, sf), DATASET), "offset")


@query(
    "lineage",
    sql(
        """SELECT m.run_id, m.image_id, r.variant, r.git_tag, r.git_commit, r.data_hash
FROM metrics m JOIN eval_runs r USING (run_id)""",
        "metrics", "eval_runs",
    ),
)
def lineage(spark, sf):
    return reports.lineage(B.eval_tables(spark, sf), DATASET)


@query(
    "median_image",
    sql(
        """SELECT run_id, image_id, dice FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY dice, image_id) AS rn,
  count(*) OVER (PARTITION BY run_id) AS n FROM metrics) WHERE rn = (n - 1) // 2 + 1""",
        "metrics",
    ),
)
def median_image(spark, sf):
    return reports.median_image(B.eval_metrics(spark, sf).select("run_id", "image_id", "dice"))


@query(
    "best_and_worst",
    _with(
        "metrics",
        """ranked AS (SELECT run_id, image_id, dice, row_number() OVER (PARTITION BY run_id ORDER BY dice DESC, image_id) AS b,
  row_number() OVER (PARTITION BY run_id ORDER BY dice, image_id) AS w, count(*) OVER (PARTITION BY run_id) AS n FROM metrics)""",
        """SELECT run_id, 'best' AS side, cast(b AS integer) AS place, image_id, dice FROM ranked WHERE b <= 3 AND n >= 6
UNION ALL SELECT run_id, 'worst', cast(w AS integer), image_id, dice FROM ranked WHERE w <= 3 AND n >= 6""",
        "metrics",
    ),
)
def best_and_worst(spark, sf):
    return reports.best_and_worst(B.eval_metrics(spark, sf), 3)


# ---------------------------------------------------------------- audits over the registry


def _reg(spark, sf):
    return B.reg_runs(spark, sf), audit.latest_status(B.reg_status_events(spark, sf))


@query("fold_latest_status", sql("SELECT * FROM reg_status", "reg_status"))
def fold_latest_status(spark, sf):
    return audit.latest_status(B.reg_status_events(spark, sf))


@query(
    "startable_folds",
    sql(
        """SELECT w.run_id, w.fold, cast(coalesce(s.attempts, 0) + 1 AS integer) AS attempts
FROM (SELECT run_id, cast(unnest(range(1, cast(config::json->'folds'->>'n_folds' AS integer) + 1)) AS integer) AS fold
  FROM reg_runs) w LEFT JOIN reg_status s ON s.run_id = w.run_id AND s.fold = w.fold
WHERE s.status IS NULL OR s.status <> 'complete'""",
        "reg_runs", "reg_status",
    ),
)
def startable_folds(spark, sf):
    runs, statuses = _reg(spark, sf)
    return audit.startable_folds(audit.expected_folds(runs), statuses)


@query(
    "complete_folds_only",
    sql(
        """SELECT a.*, s.attempts AS attempt FROM reg_assignments a JOIN reg_status s ON s.run_id = a.run_id AND s.fold = a.fold
WHERE s.status = 'complete'""",
        "reg_assignments", "reg_status",
    ),
)
def complete_folds_only(spark, sf):
    """Rows as two attempts at each fold have written them, the first of which was lost."""
    _, statuses = _reg(spark, sf)
    last = statuses.select("run_id", "fold", F.col("attempts").alias("attempt"))
    rows = B.reg_assignments(spark, sf).join(last, ["run_id", "fold"])
    lost = rows.withColumn("attempt", F.col("attempt") - 1)
    columns = ["run_id", "fold", "dataset", "image_id", "role", "attempt"]
    return audit.rows_of_complete_folds(rows.unionByName(lost).select(*columns), statuses)


N_FOLDS_SQL = "cast(config::json->'folds'->>'n_folds' AS integer)"
INCOMPLETE = f"""wanted AS (SELECT run_id, cast(unnest(range(1, {N_FOLDS_SQL} + 1)) AS integer) AS fold FROM reg_runs),
incomplete AS (SELECT w.run_id, w.fold FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM reg_status s
  WHERE s.run_id = w.run_id AND s.fold = w.fold AND s.status = 'complete'))"""


@query("incomplete_folds", _with("", INCOMPLETE, "SELECT * FROM incomplete", "reg_runs", "reg_status"))
def incomplete_folds(spark, sf):
    return audit.incomplete_folds(*_reg(spark, sf))


@query(
    "finishable_runs",
    sql(
        """SELECT r.run_id, count(s.run_id) AS n_started, count(*) FILTER (s.status <> 'complete') AS n_open,
  count(*) FILTER (s.status <> 'complete') = 0 AS can_finish
FROM reg_runs r LEFT JOIN reg_status s ON s.run_id = r.run_id GROUP BY r.run_id""",
        "reg_runs", "reg_status",
    ),
)
def finishable_runs(spark, sf):
    return audit.finishable_runs(*_reg(spark, sf))


@query(
    "resumable_runs",
    sql(
        """SELECT variant, config_hash, git_commit, data_hash, min(run_id) AS run_id, count(*) AS n_runs, count(*) > 1 AS ambiguous
FROM reg_runs WHERE finished_at IS NULL AND NOT git_dirty GROUP BY ALL""",
        "reg_runs",
    ),
)
def resumable_runs(spark, sf):
    return audit.resumable_runs(B.reg_runs(spark, sf))


@query(
    "latest_finished_run",
    sql("SELECT variant, max(run_id) AS run_id FROM reg_runs WHERE finished_at IS NOT NULL GROUP BY variant", "reg_runs"),
)
def latest_finished_run(spark, sf):
    return audit.latest_finished_run(B.reg_runs(spark, sf), ["variant"])


@query(
    "duplicate_variants",
    sql("SELECT variant, count(*) AS n_runs FROM reg_runs WHERE is_reported GROUP BY variant HAVING count(*) > 1", "reg_runs"),
)
def duplicate_variants(spark, sf):
    return audit.duplicate_variants(B.reg_runs(spark, sf))


@query(
    "never_tested",
    sql(
        """SELECT r.run_id, i.dataset, i.image_id FROM eval_images i, run_list r
WHERE i.has_labels AND NOT EXISTS (SELECT 1 FROM eval_assignments a WHERE a.run_id = r.run_id AND a.role = 'test'
  AND a.dataset = i.dataset AND a.image_id = i.image_id
  AND (a.run_id <> 'alt' OR cast(a.image_id AS bigint) % 9 <> a.fold))""",
        "eval_images", "eval_assignments",
    ),
)
def never_tested(spark, sf):
    """All four runs; one of them has lost some of its test rows."""
    lost = (F.col("run_id") == "alt") & (F.col("image_id").cast("bigint") % 9 == F.col("fold"))
    kept = B.eval_assignments(spark, sf).where(~lost)
    return audit.never_tested(B.eval_images(spark, sf), kept, [r[0] for r in B.RUNS])


@query(
    "untested_rows",
    sql(
        """SELECT m.run_id, m.dataset, m.image_id FROM reg_metrics m WHERE NOT EXISTS (SELECT 1 FROM reg_assignments a
  WHERE a.run_id = m.run_id AND a.role = 'test' AND a.dataset = m.dataset AND a.image_id = m.image_id)""",
        "reg_metrics", "reg_assignments",
    ),
)
def untested_rows(spark, sf):
    return audit.untested_rows(B.reg_metrics(spark, sf), B.reg_assignments(spark, sf))


@query(
    "artifact_digest_check",
    sql(
        """SELECT s.run_id, s.fold, CASE WHEN a.digest IS NULL THEN 'missing' ELSE 'mismatch' END AS problem
FROM reg_status s LEFT JOIN reg_artifacts a ON a.run_id = s.run_id AND a.fold = s.fold
WHERE s.status = 'complete' AND (a.digest IS NULL OR a.digest IS DISTINCT FROM s.checkpoint_sha256)""",
        "reg_status", "reg_artifacts",
    ),
)
def artifact_digest_check(spark, sf):
    _, statuses = _reg(spark, sf)
    return audit.artifact_problems(statuses, B.reg_artifacts(spark, sf))


PROBLEMS = LEAKS + f""",
done AS (SELECT run_id, count(*) AS n FROM reg_status WHERE status = 'complete' GROUP BY run_id),
facts AS (SELECT r.*, coalesce(d.n, 0) AS found, {N_FOLDS_SQL} AS n_folds,
  config::json->'training'->>'deterministic_ops' AS asked FROM reg_runs r LEFT JOIN done d USING (run_id)),
tested AS (SELECT DISTINCT run_id, dataset, image_id FROM reg_assignments WHERE role = 'test'),
coverage AS (SELECT coalesce(t.run_id, m.run_id) AS run_id, count(t.run_id) AS n_tested,
  count(*) FILTER (t.run_id IS NOT NULL AND m.done) AS n_evaluated, count(*) FILTER (t.run_id IS NULL) AS n_untested
  FROM tested t FULL JOIN (SELECT run_id, dataset, image_id, bool_or(brier IS NOT NULL) AS done FROM reg_metrics GROUP BY ALL) m
  ON t.run_id = m.run_id AND t.dataset = m.dataset AND t.image_id = m.image_id GROUP BY 1),
owing AS (SELECT DISTINCT run_id, dataset FROM reg_assignments UNION ALL SELECT run_id, dataset
  FROM (SELECT run_id FROM reg_runs EXCEPT SELECT run_id FROM reg_assignments), (SELECT DISTINCT dataset FROM reg_images)),
verified AS (SELECT * FROM (VALUES ('drive', 'F'), ('stare', 'F'), ('drive', 'O')) AS v(dataset, data_hash)),
missing AS (SELECT a.run_id, count(*) FILTER (NOT EXISTS (SELECT 1 FROM tested t WHERE t.run_id = a.run_id
    AND t.dataset = i.dataset AND t.image_id = i.image_id)) AS n
  FROM owing a JOIN reg_images i ON i.dataset = a.dataset AND i.has_labels
  GROUP BY a.run_id),
problems AS (
  SELECT run_id, 'unfinished' AS rule, found || ' of ' || coalesce(n_folds::VARCHAR, 'missing') || ' folds complete' AS detail
    FROM facts WHERE finished_at IS NULL OR found IS DISTINCT FROM n_folds
  UNION ALL SELECT run_id, 'dirty tree', '' FROM facts WHERE git_dirty IS DISTINCT FROM false
  UNION ALL SELECT run_id, 'no tag', '' FROM facts WHERE git_tag IS NULL
  UNION ALL SELECT run_id, 'hardware', coalesce(gpu_type, 'missing') || ' on ' || coalesce(compute_platform, 'missing') FROM facts
    WHERE gpu_type IS DISTINCT FROM 'Tesla T4' OR compute_platform IS DISTINCT FROM 'colab'
  UNION ALL SELECT run_id, 'determinism', 'recorded ' || coalesce(deterministic_ops::VARCHAR, 'missing') || ', asked '
    || coalesce(asked, 'missing') FROM facts WHERE deterministic_ops::VARCHAR IS DISTINCT FROM asked OR asked IS NULL
  UNION ALL SELECT run_id, 'data hash', coalesce(data_hash, 'missing') FROM facts r WHERE EXISTS (
    SELECT 1 FROM reg_assignments a WHERE a.run_id = r.run_id AND NOT EXISTS (
      SELECT 1 FROM verified v WHERE v.dataset = a.dataset AND v.data_hash = r.data_hash))
    OR (r.run_id NOT IN (SELECT run_id FROM reg_assignments) AND NOT EXISTS (SELECT 1 FROM verified v WHERE v.data_hash = r.data_hash))
  UNION ALL SELECT run_id, 'never tested', n || ' labelled images' FROM missing WHERE n > 0
  UNION ALL SELECT run_id, 'partly evaluated', n_evaluated || ' of ' || n_tested FROM coverage WHERE n_evaluated <> n_tested
  UNION ALL SELECT run_id, 'rows for untested', n_untested || ' images' FROM coverage WHERE n_untested > 0
  UNION ALL SELECT r.run_id, 'evaluation', CASE WHEN e.commit IS NULL THEN 'missing'
    ELSE 'by ' || e.commit || CASE WHEN e.dirty THEN ' (dirty)' WHEN e.dirty IS NULL THEN ' (unknown)' ELSE '' END END
    FROM reg_runs r LEFT JOIN reg_evaluations e USING (run_id)
    WHERE e.commit IS NULL OR e.commit IS DISTINCT FROM r.git_commit OR e.dirty IS DISTINCT FROM false
  UNION ALL SELECT s.run_id, 'checkpoint', 'fold ' || s.fold || ': ' || CASE WHEN a.digest IS NULL THEN 'missing' ELSE 'mismatch' END
    FROM reg_status s LEFT JOIN reg_artifacts a ON a.run_id = s.run_id AND a.fold = s.fold
    WHERE s.status = 'complete' AND (a.digest IS NULL OR a.digest IS DISTINCT FROM s.checkpoint_sha256)
  UNION ALL SELECT run_id, 'leakage', count(*) || ' rows' FROM leaks GROUP BY run_id)"""
PROBLEM_NEEDS = (
    "reg_runs", "reg_status", "reg_assignments", "reg_metrics", "reg_images", "reg_evaluations", "reg_artifacts",
)


def _reportability(spark, sf):
    runs, statuses = _reg(spark, sf)
    held = F.col("o_orderstatus")
    datasets = F.when(held == "F", F.array(F.lit(DATASET), F.lit("stare"))).when(held == "O", F.array(F.lit(DATASET)))
    verified = (
        table(spark, sf, "orders").select(F.explode(datasets).alias("dataset"), held.alias("data_hash")).distinct()
    )
    return runs, audit.reportability(
        runs, statuses, B.reg_assignments(spark, sf), B.reg_metrics(spark, sf), B.reg_images(spark, sf),
        B.reg_evaluations(spark, sf), B.reg_artifacts(spark, sf), verified,
        gpu_type="Tesla T4", platform="colab",
    )


@query("reportability", _with("", PROBLEMS, "SELECT * FROM problems", *PROBLEM_NEEDS))
def reportability(spark, sf):
    return _reportability(spark, sf)[1]


@query(
    "reportable_runs",
    _with(
        "", PROBLEMS,
        """SELECT run_id, variant, true AS is_reported FROM reg_runs WHERE run_id NOT IN (SELECT run_id FROM problems
  WHERE rule NOT IN ('never tested', 'partly evaluated', 'unfinished', 'evaluation', 'checkpoint'))""",
        *PROBLEM_NEEDS,
    ),
)
def reportable_runs(spark, sf):
    """Coverage, evaluation and artifact rules are waived: no order passes them all."""
    runs, problems = _reportability(spark, sf)
    waived = ["never tested", "partly evaluated", "unfinished", "evaluation", "checkpoint"]
    out = audit.mark_reportable(runs, problems.where(~F.col("rule").isin(waived)))
    return out.select("run_id", "variant", "is_reported")


@query(
    "tabulation_refusals",
    sql(
        """SELECT run_id, rule FROM (SELECT r.run_id, unnest([
  CASE WHEN finished_at IS NULL THEN 'unfinished' END,
  CASE WHEN m.n IS NULL OR m.o > 0 THEN 'not evaluated' END,
  CASE WHEN NOT is_reported THEN 'not reported' END,
  CASE WHEN is_reported AND d.variant IS NOT NULL THEN 'more than one run per variant' END]) AS rule
  FROM reg_runs r LEFT JOIN (SELECT run_id, count(*) AS n, count(*) FILTER (brier IS NULL) AS o FROM reg_metrics GROUP BY 1) m
    USING (run_id)
  LEFT JOIN (SELECT variant FROM reg_runs WHERE is_reported GROUP BY 1 HAVING count(*) > 1) d USING (variant))
WHERE rule IS NOT NULL""",
        "reg_runs", "reg_metrics",
    ),
)
def tabulation_refusals(spark, sf):
    return audit.tabulation_refusals(B.reg_runs(spark, sf), B.reg_metrics(spark, sf))


ENV = ("python_version", "tensorflow_version", "cuda_version", "gpu_type", "compute_platform")


@query(
    "env_changes",
    _with(
        "",
        """b AS (SELECT run_id, field, was FROM reg_runs UNPIVOT INCLUDE NULLS
  (was FOR field IN (python_version, tensorflow_version, cuda_version, gpu_type, compute_platform))),
later AS (SELECT * REPLACE (CASE WHEN seed % 3 = 0 THEN '2.22' ELSE tensorflow_version END AS tensorflow_version,
  CASE WHEN seed % 4 = 0 THEN NULL ELSE cuda_version END AS cuda_version) FROM reg_runs),
a AS (SELECT run_id, field, now FROM later UNPIVOT INCLUDE NULLS
  (now FOR field IN (python_version, tensorflow_version, cuda_version, gpu_type, compute_platform)))""",
        "SELECT run_id, field, was, now FROM b JOIN a USING (run_id, field) WHERE was IS DISTINCT FROM now",
        "reg_runs",
    ),
)
def env_changes(spark, sf):
    runs = B.reg_runs(spark, sf)
    later = runs.withColumns(
        {
            "tensorflow_version": F.when(F.col("seed") % 3 == 0, "2.22").otherwise(F.col("tensorflow_version")),
            "cuda_version": F.when(F.col("seed") % 4 != 0, F.col("cuda_version")),
        }
    )
    return audit.env_changes(runs, later, "run_id", ENV)


@query(
    "run_manifest",
    sql(
        f"""SELECT run_id, variant, {N_FOLDS_SQL} AS n_folds,
  cast(config::json->'training'->>'deterministic_ops' AS boolean) AS asked_deterministic, git_commit, finished_at
FROM reg_runs""",
        "reg_runs",
    ),
)
def run_manifest(spark, sf):
    """Runs read back with their configuration parsed."""
    schema = "folds struct<n_folds:int>, training struct<deterministic_ops:boolean>"
    return B.reg_runs(spark, sf).withColumn("c", F.from_json("config", schema)).select(
        "run_id", "variant", F.col("c.folds.n_folds").alias("n_folds"),
        F.col("c.training.deterministic_ops").alias("asked_deterministic"), "git_commit", "finished_at",
    )


@query(
    "json_fields",
    "SELECT event_id, cast(props::json->>'k' AS bigint) AS k FROM events",
)
def json_fields(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query(
    "config_hash",
    """SELECT event_id, sha256('{"data":{"fold":' || user_id || ',"k":"' || (props::json->>'k') || '"},"k":'
  || (props::json->>'k') || ',"type":"' || event_type || '"}') AS config_hash
FROM events""",
)
def config_hash(spark, sf):
    """Nested configs; the keys of both levels are written in another order for odd events."""
    k, fold = F.get_json_object("props", "$.k"), F.col("user_id").cast("string")
    data_a = F.concat(F.lit('{"k": "'), k, F.lit('", "fold": '), fold, F.lit("}"))
    data_b = F.concat(F.lit('{ "fold":'), fold, F.lit(', "k":"'), k, F.lit('" }'))
    a = F.concat(F.lit('{"k": '), k, F.lit(', "type": "'), "event_type", F.lit('", "data": '), data_a, F.lit("}"))
    b = F.concat(F.lit('{"data": '), data_b, F.lit(', "type": "'), "event_type", F.lit('", "k": '), k, F.lit("}"))
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 2 == 1, a).otherwise(b).alias("config"))
    return reconcile.config_hash(e, "event_id", "config")


# ---------------------------------------------------------------- recomputed against stored

CHECKED = ("fold", "dice", "sensitivity", "specificity", "precision_score", "accuracy", "predicted_vessel_fraction")


def _tampered(df):
    user = F.col("image_id").cast("bigint")
    return df.where(user % 40 != 3).withColumns(
        {
            "fold": F.when(user % 40 == 5, F.col("fold") + 1).otherwise(F.col("fold")),
            "dice": F.when(user % 20 == 7, F.col("dice") / 2).otherwise(F.col("dice")),
            "sensitivity": F.when(user % 20 != 11, F.col("sensitivity")),
        }
    )


NAMES_SQL = ", ".join(f"CASE WHEN s.{c} IS DISTINCT FROM c.{c} THEN '{c}' END" for c in CHECKED)


@query(
    "recompute_mismatches",
    _with(
        "",
        """kept AS (SELECT * REPLACE (CASE WHEN cast(image_id AS bigint) % 40 = 5 THEN fold + 1 ELSE fold END AS fold,
  CASE WHEN cast(image_id AS bigint) % 20 = 7 THEN dice / 2 ELSE dice END AS dice,
  CASE WHEN cast(image_id AS bigint) % 20 <> 11 THEN sensitivity END AS sensitivity)
  FROM item_metrics WHERE cast(image_id AS bigint) % 40 <> 3)""",
        f"""SELECT * FROM (SELECT coalesce(s.run_id, c.run_id) AS run_id, coalesce(s.image_id, c.image_id) AS image_id,
  CASE WHEN s.run_id IS NULL THEN 'not stored' WHEN c.run_id IS NULL THEN 'not recomputed'
    WHEN concat_ws(',', {NAMES_SQL}) <> '' THEN 'differs: ' || concat_ws(',', {NAMES_SQL}) END AS problem
  FROM kept s FULL JOIN item_metrics c ON s.run_id = c.run_id AND s.image_id = c.image_id) WHERE problem IS NOT NULL""",
        "item_metrics",
    ),
)
def recompute_mismatches(spark, sf):
    from workload.scoring import binary_metrics

    computed = binary_metrics(spark, sf)
    return reconcile.compare_rows(_tampered(computed), computed, ["run_id", "image_id"], CHECKED)


@query(
    "fill_evaluation",
    sql(
        """SELECT b.run_id, b.dataset, b.image_id, b.dice,
  CASE WHEN b.run_id IN ('base', 'alt') THEN round(a.auc_roc, 9) END AS auc_roc,
  CASE WHEN b.run_id IN ('base', 'alt') THEN round(b.brier, 9) END AS brier
FROM item_metrics b JOIN areas a USING (run_id, dataset, image_id)""",
        "item_metrics", "areas",
    ),
)
def fill_evaluation(spark, sf):
    """Rows as training stored them, then filled for two of the four runs."""
    from workload.scoring import evaluate_items

    done = evaluate_items(spark, sf)
    key = ["run_id", "dataset", "image_id"]
    nothing = F.lit(None).cast("double")
    before = done.select(*key, "dice", nothing.alias("auc_roc"), nothing.alias("brier"))
    records = done.where("run_id IN ('base', 'alt')").select(*key, "auc_roc", "brier")
    return reconcile.fill_evaluation(before, records, key, ["auc_roc", "brier"])


@query(
    "unfillable_records",
    sql(
        """SELECT r.run_id, r.dataset, r.image_id, coalesce(s.n, 0) AS n_rows FROM reg_metrics r
LEFT JOIN (SELECT run_id, dataset, image_id, count(*) AS n FROM reg_assignments GROUP BY ALL) s
  ON s.run_id = r.run_id AND s.dataset = r.dataset AND s.image_id = r.image_id WHERE coalesce(s.n, 0) <> 1""",
        "reg_metrics", "reg_assignments",
    ),
)
def unfillable_records(spark, sf):
    return reconcile.unfillable(
        B.reg_assignments(spark, sf), B.reg_metrics(spark, sf), ["run_id", "dataset", "image_id"]
    )


@query(
    "upsert_classify",
    """SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_custkey % 5 = 0 THEN 'new'
  WHEN c_custkey % 7 = 0 OR c_custkey % 11 = 0 THEN 'conflict' ELSE 'same' END AS status
FROM (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_name END AS c_name, c_acctbal FROM customer)""",
)
def upsert_classify(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    stored_rows = c.where("c_custkey % 5 <> 0").withColumn(
        "c_acctbal", F.when(F.col("c_custkey") % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))
    )
    incoming = c.withColumn("c_name", F.when(F.col("c_custkey") % 11 != 0, F.col("c_name")))
    return reconcile.classify_upsert(incoming, stored_rows, ["c_custkey"])


EDGE_PROBLEM = """CASE WHEN t.run_id IS NULL THEN 'not in the registry' WHEN e.run_id IS NULL THEN 'not in the summary'
  WHEN e.threshold IS DISTINCT FROM t.threshold THEN 'thresholds differ' END"""


@query(
    "fold_edge_reconcile",
    sql(
        f"""SELECT * FROM (SELECT coalesce(e.run_id, t.run_id) AS run_id, coalesce(e.fold, t.fold) AS fold, {EDGE_PROBLEM} AS problem
  FROM (SELECT run_id, fold + CASE WHEN fold = 4 AND run_id < '3' THEN 3 ELSE 0 END AS fold,
    CASE WHEN fold = 2 THEN threshold + 0.01::double ELSE threshold END AS threshold FROM history_thresholds) e
  FULL JOIN history_thresholds t ON t.run_id = e.run_id AND t.fold = e.fold) WHERE problem IS NOT NULL""",
        "history_thresholds",
    ),
)
def fold_edge_reconcile(spark, sf):
    """Summaries with a changed threshold in fold 2 and a misnumbered fold 4."""
    t = B.history_tables(spark, sf)["thresholds"]
    edges = t.select(
        "run_id",
        (F.col("fold") + F.when((F.col("fold") == 4) & (F.col("run_id") < "3"), 3).otherwise(0)).alias("fold"),
        F.when(F.col("fold") == 2, F.col("threshold") + F.lit(0.01)).otherwise(F.col("threshold")).alias("threshold"),
    )
    return reports.fold_edge_reconcile(edges, t)


# ---------------------------------------------------------------- manifests and digests


def _merkle() -> str:
    """SQL of a digest over parts that share eight, six, four, two and no digits of the md5 of their path."""
    out = ["""level0 AS (SELECT split_part(path, '/', 1) AS source, md5(path) AS k, path AS o,
  digest || '  ' || path || chr(10) AS t, 1 AS n FROM manifest)"""]
    for i, digits in enumerate((8, 6, 4, 2, 0), 1):
        out.append(
            f"level{i} AS (SELECT source, left(k, {digits}) AS k, left(k, {digits}) AS o,"
            f" sha256(string_agg(t, '' ORDER BY o)) AS t, sum(n) AS n FROM level{i - 1} GROUP BY source, left(k, {digits}))"
        )
    return ",\n".join(out)


MERKLE = _merkle()


@query("content_digests", sql("SELECT path, digest FROM manifest", "manifest"))
def content_digests(spark, sf):
    return B.manifest(spark, sf).select("path", "digest")


@query(
    "data_hash",
    _with("", MERKLE, "SELECT source, n::BIGINT AS n_lines, t AS data_hash FROM level5", "manifest"),
)
def data_hash(spark, sf):
    m = B.manifest(spark, sf).withColumn("source", S.path_prefix(F.col("path")))
    return reconcile.data_hash(m, ["source"])


VERIFY = """CASE WHEN f.path IS NULL THEN 'missing' WHEN m.path IS NULL THEN 'unlisted'
  WHEN m.digest <> f.digest THEN 'mismatched' END"""


@query(
    "checksum_verify",
    sql(
        f"""SELECT * FROM (SELECT coalesce(m.path, f.path) AS path, {VERIFY} AS problem
  FROM manifest m FULL JOIN files f ON f.path = m.path) WHERE problem IS NOT NULL""",
        "manifest", "files",
    ),
)
def checksum_verify(spark, sf):
    return reconcile.verify_checksums(B.manifest(spark, sf), B.files(spark, sf))


@query(
    "checksum_verify_sources",
    sql(
        f"""SELECT * FROM (SELECT coalesce(m.path, f.path) AS path, {VERIFY} AS problem
  FROM manifest m FULL JOIN files f ON f.path = m.path) WHERE problem IS NOT NULL
  AND split_part(path, '/', 1) IN ('src1', 'src4')""",
        "manifest", "files",
    ),
)
def checksum_verify_sources(spark, sf):
    return reconcile.verify_checksums(B.manifest(spark, sf), B.files(spark, sf), ["src1", "src4"])


@query(
    "layout_reconcile",
    """SELECT * FROM (SELECT coalesce(e.path, f.path) AS path, CASE WHEN f.path IS NULL THEN 'missing'
    WHEN e.path IS NULL THEN 'unexpected' END AS problem
  FROM (SELECT source || '/' || printf('%06d', doc_id) || '_image.tif' AS path FROM documents
        UNION ALL SELECT source || '/' || printf('%06d', doc_id) || '_mask.gif' FROM documents) e
  FULL JOIN (SELECT d.source || '/' || printf('%06d', d.doc_id) || '_image.tif' AS path FROM documents d
        UNION ALL SELECT d.source || '/' || printf('%06d', d.doc_id) || '_mask.gif' FROM documents d JOIN labels USING (doc_id)
        UNION ALL SELECT d.source || '/' || d.doc_id || '.txt' FROM documents d WHERE d.doc_id % 19 = 0) f
  ON e.path = f.path) WHERE problem IS NOT NULL""",
)
def layout_reconcile(spark, sf):
    """Every document owes an image and a mask; masks exist for labelled ones, and hidden files do not count."""
    d = table(spark, sf, "documents").select("source", "doc_id")
    number = S.padded_id(F.col("doc_id"), 6)
    kinds = F.array(F.lit("_image.tif"), F.lit("_mask.gif"))
    expected = d.withColumn("kind", F.explode(kinds)).select(
        F.concat("source", F.lit("/"), number, "kind").alias("path")
    )
    labelled = d.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    extra = d.where("doc_id % 19 = 0")
    found = (
        d.select(F.concat("source", F.lit("/"), number, F.lit("_image.tif")).alias("path"))
        .unionByName(labelled.select(F.concat("source", F.lit("/"), number, F.lit("_mask.gif")).alias("path")))
        .unionByName(extra.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path")))
        .unionByName(extra.select(F.concat("source", F.lit("/."), F.col("doc_id").cast("string")).alias("path")))
    )
    return reconcile.reconcile_paths(expected, found)


@query(
    "manifest_parse",
    _with(
        "",
        """lines AS (SELECT doc_id * 2 AS line, CASE WHEN doc_id % 10 = 3 THEN upper(digest) || '  ' || path
    WHEN doc_id % 10 = 4 THEN digest || ' ' || path WHEN doc_id % 10 = 5 THEN '  ' ELSE digest || '  ' || path END AS text
  FROM manifest UNION ALL SELECT doc_id * 2 + 1, digest || '  ' || path FROM manifest WHERE doc_id % 10 = 6),
parsed AS (SELECT line, nullif(regexp_extract(text, '^([0-9a-f]{64})  (.+)$', 2), '') AS path,
  nullif(regexp_extract(text, '^([0-9a-f]{64})  (.+)$', 1), '') AS digest FROM lines WHERE trim(text) <> '')""",
        """SELECT line, path, digest, CASE WHEN path IS NULL THEN 'malformed'
  WHEN line > min(line) OVER (PARTITION BY path) THEN 'listed twice' END AS problem FROM parsed""",
        "manifest",
    ),
)
def manifest_parse(spark, sf):
    """Manifest text with upper-case digests, single spaces, blank lines and repeated paths."""
    m = B.manifest(spark, sf)
    k, good = F.col("doc_id") % 10, reconcile.manifest_line(F.col("path"), F.col("digest"))
    text = (
        F.when(k == 3, F.concat(F.upper("digest"), F.lit("  "), "path"))
        .when(k == 4, F.concat("digest", F.lit(" "), "path"))
        .when(k == 5, F.lit("  "))
        .otherwise(good)
    )
    lines = m.select((F.col("doc_id") * 2).alias("line"), text.alias("text")).unionByName(
        m.where("doc_id % 10 = 6").select((F.col("doc_id") * 2 + 1).alias("line"), good.alias("text"))
    )
    return reconcile.parse_manifest(lines, "text", "line")


@query(
    "prediction_hash_check",
    sql(
        """SELECT * FROM (SELECT coalesce(m.doc_id, f.doc_id) AS doc_id, CASE WHEN f.doc_id IS NULL THEN 'missing'
    WHEN m.doc_id IS NULL THEN 'unexpected' WHEN m.digest IS DISTINCT FROM f.digest THEN 'mismatch' END AS problem
  FROM (SELECT doc_id, digest FROM manifest WHERE doc_id % 8 <> 0) m
  FULL JOIN (SELECT doc_id, CASE WHEN quality = 0 THEN NULL ELSE digest END AS digest FROM manifest JOIN labels USING (doc_id)) f
  ON f.doc_id = m.doc_id) WHERE problem IS NOT NULL""",
        "manifest",
    ),
)
def prediction_hash_check(spark, sf):
    m = B.manifest(spark, sf)
    have = m.join(table(spark, sf, "labels"), "doc_id").select(
        "doc_id", F.when(F.col("quality") != 0, F.col("digest")).alias("digest")
    )
    return reconcile.compare_digests(m.where("doc_id % 8 <> 0"), have, ["doc_id"])


# ---------------------------------------------------------------- data quality


def _rules(df, keys, names):
    every = schemas.rules("images")
    return quality.violations(df, keys, {n: every[n] for n in names})


META_KEYS = ["dataset", "image_id"]


def _violation_sql(rules: dict[str, str], source: str, keys: str) -> str:
    return "\nUNION ALL ".join(
        f"SELECT {keys}, '{name}' AS rule FROM {source} WHERE NOT ({text})" for name, text in rules.items()
    )


@query(
    "dq_enum",
    sql(
        _violation_sql(
            {
                "dataset_enum": "dataset IN ('drive', 'stare', 'chase')",
                "split_enum": "split IN ('training', 'test', 'external')",
                "fov_source_enum": "fov_source IN ('official', 'generated')",
            },
            "images_meta", "dataset, image_id",
        ),
        "images_meta",
    ),
)
def dq_enum(spark, sf):
    return _rules(B.images_meta(spark, sf), META_KEYS, ["dataset_enum", "split_enum", "fov_source_enum"])


@query(
    "dq_range",
    sql(
        _violation_sql(
            {
                "vessel_fraction_in_fov_unit": "vessel_fraction_in_fov BETWEEN 0 AND 1",
                "fov_pixels_min": "fov_pixels >= 1",
            },
            "images_meta", "dataset, image_id",
        ),
        "images_meta",
    ),
)
def dq_range(spark, sf):
    return _rules(B.images_meta(spark, sf), META_KEYS, ["vessel_fraction_in_fov_unit", "fov_pixels_min"])


LOST = {
    "fold_status": ("reg_status_events", "run_id", "started_at", "fold = 2"),
    "runs": ("reg_runs", "run_id", "git_commit", "seed % 21 = 0"),
    "fold_assignments": ("reg_assignments", "run_id", "role", "image_id = 'i7'"),
}


def _required_sql() -> str:
    out = []
    for name, (source, key, column, where) in LOST.items():
        own = [c for c in [*schemas.KEYS[name], *schemas.REQUIRED[name]] if c != "device"]
        rows = f"(SELECT * REPLACE (CASE WHEN NOT ({where}) THEN {column} END AS {column}) FROM {source})"
        out += [
            f"SELECT '{name}' AS table_name, {key}::VARCHAR AS key, '{c}_not_null' AS rule FROM {rows} WHERE {c} IS NULL"
            for c in own
        ]
    return "\nUNION ALL ".join(out)


@query("dq_not_null", sql(_required_sql(), "reg_runs", "reg_assignments", "reg_status_events"))
def dq_not_null(spark, sf):
    """Columns that may not be NULL, in three tables that each have lost some values of one column."""
    tables = {"fold_status": B.reg_status_events, "runs": B.reg_runs, "fold_assignments": B.reg_assignments}
    out = None
    for name, (_, key, column, where) in LOST.items():
        df = tables[name](spark, sf)
        df = df.withColumn(column, F.when(~F.expr(where), F.col(column)))
        rules = {n: r for n, r in schemas.required_rules(name).items() if n != "device_not_null"}
        part = quality.violations(df, [key], rules).select(
            F.lit(name).alias("table_name"), F.col(key).cast("string").alias("key"), "rule"
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "dq_cross",
    sql(
        _violation_sql(
            {
                "fraction_needs_labels": "has_labels OR vessel_fraction_in_fov IS NULL",
                "abnormal_iff_note": "has_abnormality = (abnormality_note IS NOT NULL AND abnormality_note <> '')",
            },
            "images_meta", "dataset || '/' || image_id AS key",
        )
        + "\nUNION ALL "
        + _violation_sql(
            {"model_and_threshold_together": "(frozen_model_id IS NULL) = (applied_threshold IS NULL)"},
            "reg_runs", "run_id AS key",
        )
        + "\nUNION ALL "
        + _violation_sql(
            {"complete_needs_outputs": "status = 'running' OR (checkpoint_sha256 IS NOT NULL AND completed_at IS NOT NULL)"},
            "(SELECT * REPLACE (CASE WHEN fold = 3 THEN NULL ELSE completed_at END AS completed_at) FROM reg_status_events)",
            "run_id || '/' || fold AS key",
        ),
        "images_meta", "reg_runs", "reg_status_events",
    ),
)
def dq_cross(spark, sf):
    """Cross-column rules of three tables; fold 3 has lost its completion times."""
    meta = _rules(B.images_meta(spark, sf), META_KEYS, ["fraction_needs_labels", "abnormal_iff_note"])
    name = "model_and_threshold_together"
    runs = quality.violations(B.reg_runs(spark, sf), ["run_id"], {name: schemas.rules("runs")[name]})
    events = B.reg_status_events(spark, sf).withColumn(
        "completed_at", F.when(F.col("fold") != 3, F.col("completed_at"))
    )
    name = "complete_needs_outputs"
    folds_ = quality.violations(events, ["run_id", "fold"], {name: schemas.rules("fold_status")[name]})
    return (
        meta.select(F.concat("dataset", F.lit("/"), "image_id").alias("key"), "rule")
        .unionByName(runs.select(F.col("run_id").alias("key"), "rule"))
        .unionByName(folds_.select(F.concat("run_id", F.lit("/"), F.col("fold").cast("string")).alias("key"), "rule"))
    )


@query(
    "dq_reported",
    sql(
        _violation_sql(
            {
                "reported_needs_clean_tree": "NOT is_reported OR NOT git_dirty",
                "reported_needs_tag": "NOT is_reported OR git_tag IS NOT NULL",
                "reported_needs_finish": "NOT is_reported OR finished_at IS NOT NULL",
            },
            "(SELECT * REPLACE (seed % 6 = 1 AS is_reported) FROM reg_runs)", "run_id",
        ),
        "reg_runs",
    ),
)
def dq_reported(spark, sf):
    runs = B.reg_runs(spark, sf).withColumn("is_reported", F.col("seed") % 6 == 1)
    return quality.violations(runs, ["run_id"], schemas.reported_rules())


@query(
    "dq_pk",
    sql(
        """SELECT run_id, fold, image_id, role, count(*) AS n_rows FROM reg_assignments GROUP BY ALL HAVING count(*) > 1""",
        "reg_assignments",
    ),
)
def dq_pk(spark, sf):
    return quality.duplicate_keys(B.reg_assignments(spark, sf), schemas.KEYS["fold_assignments"])


@query(
    "dq_fk",
    sql(
        """SELECT DISTINCT 'fold_assignments(run_id)' AS reference, run_id AS key FROM reg_assignments
  WHERE run_id NOT IN (SELECT run_id FROM reg_runs WHERE seed % 10 <> 0)
UNION ALL SELECT DISTINCT 'fold_assignments(dataset,image_id)', dataset || '/' || image_id FROM reg_assignments
  WHERE image_id NOT IN (SELECT image_id FROM reg_images)
UNION ALL SELECT DISTINCT 'per_image_metrics(run_id)', run_id FROM reg_metrics
  WHERE run_id NOT IN (SELECT run_id FROM reg_runs WHERE seed % 10 <> 0)
UNION ALL SELECT DISTINCT 'per_image_metrics(dataset,image_id)', dataset || '/' || image_id FROM reg_metrics
  WHERE image_id NOT IN (SELECT image_id FROM reg_images)""",
        "reg_assignments", "reg_runs", "reg_images", "reg_metrics",
    ),
)
def dq_fk(spark, sf):
    """Every tenth run is missing from the registry."""
    return reports.dangling_references(
        {
            "runs": B.reg_runs(spark, sf).where("seed % 10 <> 0"),
            "fold_assignments": B.reg_assignments(spark, sf),
            "images": B.reg_images(spark, sf),
            "per_image_metrics": B.reg_metrics(spark, sf),
        }
    )


@query(
    "snapshot_rows",
    sql(
        """SELECT 'fold_assignments' AS name, count(*) AS n_rows FROM reg_assignments
  WHERE run_id IN (SELECT run_id FROM reg_runs WHERE is_reported)
UNION ALL SELECT 'images', count(*) FROM reg_images
UNION ALL SELECT 'per_image_metrics', count(*) FROM reg_metrics WHERE run_id IN (SELECT run_id FROM reg_runs WHERE is_reported)
UNION ALL SELECT 'runs', count(*) FROM reg_runs WHERE is_reported""",
        "reg_assignments", "reg_runs", "reg_images", "reg_metrics",
    ),
)
def snapshot_rows(spark, sf):
    chosen = reports.snapshot(
        {
            "runs": B.reg_runs(spark, sf),
            "fold_assignments": B.reg_assignments(spark, sf),
            "images": B.reg_images(spark, sf),
            "per_image_metrics": B.reg_metrics(spark, sf),
        }
    )
    out = None
    for name, df in chosen.items():
        part = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), "n_rows")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "timestamp_roundtrip",
    _with(
        "",
        """texts AS (SELECT run_id, CASE WHEN seed % 10 = 1 THEN substr(started_at, 1, 10) || 'T24:00:00Z'
    WHEN seed % 10 = 2 THEN replace(started_at, '-01-', '-13-') ELSE started_at END AS t, seed FROM reg_runs)""",
        """SELECT run_id, t, CASE WHEN t IS NOT NULL THEN
  coalesce(strftime(try_strptime(t, '%Y-%m-%dT%H:%M:%SZ'), '%Y-%m-%dT%H:%M:%SZ') = t, false) END AS ok FROM texts""",
        "reg_runs",
    ),
)
def timestamp_roundtrip(spark, sf):
    day = F.col("seed") % 10
    t = (
        F.when(day == 1, F.concat(F.substring("started_at", 1, 10), F.lit("T24:00:00Z")))
        .when(day == 2, F.replace("started_at", F.lit("-01-"), F.lit("-13-")))
        .otherwise(F.col("started_at"))
    )
    return B.reg_runs(spark, sf).select("run_id", t.alias("t")).withColumn("ok", S.timestamp_ok(F.col("t")))


@query(
    "duration_minutes",
    sql(
        """SELECT run_id, cast(round_even(date_diff('second', try_strptime(started_at, '%Y-%m-%dT%H:%M:%SZ'),
  try_strptime(finished_at, '%Y-%m-%dT%H:%M:%SZ')) / 60.0::double, 0) AS bigint) AS minutes FROM reg_runs""",
        "reg_runs",
    ),
)
def duration_minutes(spark, sf):
    return B.reg_runs(spark, sf).select(
        "run_id", S.minutes_between(F.col("started_at"), F.col("finished_at")).alias("minutes")
    )


@query(
    "path_prefix",
    sql("SELECT path, split_part(path, '/', 1) AS prefix FROM files", "files"),
)
def path_prefix(spark, sf):
    return B.files(spark, sf).select("path", S.path_prefix(F.col("path")).alias("prefix"))


@query("id_format", "SELECT c_custkey, printf('%02d', c_custkey) AS id FROM customer")
def id_format(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", S.padded_id(F.col("c_custkey")).alias("id"))


@query(
    "run_id_format",
    "SELECT event_id, strftime(ts, '%Y%m%dT%H%M%SZ') || '-' || substr(md5(cast(event_id AS varchar)), 1, 6) AS run_id FROM events",
)
def run_id_format(spark, sf):
    return table(spark, sf, "events").select("event_id", S.run_id_text(F.col("ts"), F.col("event_id")).alias("run_id"))


@query(
    "format_na",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 3 THEN 'NA'
  ELSE printf('%.3f', l_quantity / 4.0::double) END AS text FROM lineitem""",
)
def format_na(spark, sf):
    """Quarters print exactly with three decimals, so both engines must agree."""
    value = F.when(F.col("l_linenumber") != 3, F.col("l_quantity") / F.lit(4.0))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", S.format_na(value, 3).alias("text")
    )


@query(
    "tag_pattern",
    sql(
        r"""SELECT run_id, git_tag, regexp_matches(git_tag, '^v\d+\.\d+\.\d+(-[0-9A-Za-z.]+)?$') AS is_release FROM reg_runs""",
        "reg_runs",
    ),
)
def tag_pattern(spark, sf):
    return B.reg_runs(spark, sf).select("run_id", "git_tag", S.is_release_tag(F.col("git_tag")).alias("is_release"))
