"""Queries over scored items: confusion, ranks, calibration, thresholds, losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskaudit.functions import scalars as S
from maskaudit.operators import losses, metrics, ranking, reconcile, stats
from workload.bindings import (
    FOLD_THRESHOLD_SQL, ITEM, dice_sql, eval_assignments, eval_metrics, fold_threshold, grid_sql,
    query, ratio_sql, scored, scored_runs, sql, table,
)

ITEM_SQL = "run_id, dataset, image_id, fold"


def r9(df, *columns):
    return df.withColumns({c: F.round(c, 9) for c in columns})


@query(
    "evaluate_items",
    sql(
        f"""SELECT {ITEM_SQL}, tp, fp, fn, tn, dice, sensitivity, specificity, precision_score, accuracy,
       predicted_vessel_fraction, round(brier, 9) AS brier, round(auc_roc, 9) AS auc_roc, round(auc_pr, 9) AS auc_pr
FROM item_metrics JOIN areas USING ({ITEM_SQL})""",
        "item_metrics", "areas",
    ),
)
def evaluate_items(spark, sf):
    out = metrics.evaluate_items(scored_runs(spark, sf), ITEM, fold_threshold())
    return r9(out, "brier", "auc_roc", "auc_pr")


@query("confusion_counts", sql(f"SELECT {ITEM_SQL}, tp, fp, fn, tn FROM confusion", "confusion"))
def confusion_counts(spark, sf):
    return metrics.confusion_counts(scored_runs(spark, sf), ITEM, fold_threshold())


@query(
    "binary_metrics",
    sql(
        f"""SELECT {ITEM_SQL}, tp, fp, fn, tn, dice, sensitivity, specificity, precision_score, accuracy,
       predicted_vessel_fraction FROM item_metrics""",
        "item_metrics",
    ),
)
def binary_metrics(spark, sf):
    return metrics.binary_metrics(
        metrics.confusion_counts(scored_runs(spark, sf), ITEM, fold_threshold())
    )


@query("auc_roc", sql(f"SELECT {ITEM_SQL}, round(auc_roc, 9) AS auc_roc FROM areas", "areas"))
def auc_roc(spark, sf):
    ranks = metrics.rank_metrics(metrics.score_counts(scored_runs(spark, sf), ITEM), ITEM)
    return r9(ranks.select(*ITEM, "auc_roc"), "auc_roc")


@query("average_precision", sql(f"SELECT {ITEM_SQL}, round(auc_pr, 9) AS auc_pr FROM areas", "areas"))
def average_precision(spark, sf):
    ranks = metrics.rank_metrics(metrics.score_counts(scored_runs(spark, sf), ITEM), ITEM)
    return r9(ranks.select(*ITEM, "auc_pr"), "auc_pr")


POOLED = """WITH c AS (SELECT run_id, prob, count(*) FILTER (label) AS v, count(*) FILTER (NOT label) AS b
  FROM ({scored}) WHERE in_fov GROUP BY ALL),
r AS (SELECT *, sum(b) OVER (PARTITION BY run_id ORDER BY prob) - b AS below,
      sum(v) OVER (PARTITION BY run_id ORDER BY prob DESC) AS tp,
      sum(b) OVER (PARTITION BY run_id ORDER BY prob DESC) AS fp FROM c)
SELECT run_id, cast(sum(v) AS bigint) AS n_pos, cast(sum(b) AS bigint) AS n_neg,
  round(cast(sum(v * (2 * below + b)) AS double) / (2.0::double * sum(v) * sum(b)), 9) AS auc_roc,
  round(sum(v * (cast(tp AS double) / cast(tp + fp AS double))) / sum(v), 9) AS auc_pr
FROM r GROUP BY run_id"""


@query("pooled_areas", POOLED.replace("{scored}", sql("SELECT * FROM scored_runs", "scored_runs")))
def pooled_areas(spark, sf):
    s = scored_runs(spark, sf)
    return r9(metrics.rank_metrics(metrics.score_counts(s, ["run_id"]), ["run_id"]), "auc_roc", "auc_pr")


@query("brier", sql(f"SELECT {ITEM_SQL}, round(brier, 9) AS brier FROM confusion", "confusion"))
def brier(spark, sf):
    return r9(metrics.brier(scored_runs(spark, sf), ITEM), "brier")


BINNED = f"""bins AS (SELECT run_id, least({grid_sql('p', 10)}, 9) AS bin, count(*) AS n,
  count(*) FILTER (label) AS n_pos, sum(p) AS sp, sum(pow(p - cast(label AS integer), 2)) AS sq
  FROM (SELECT *, cast(prob AS double) AS p FROM scored_runs WHERE in_fov) GROUP BY ALL),
filled AS (SELECT r.run_id, cast(k.bin AS bigint) AS bin, coalesce(n, 0) AS n, coalesce(n_pos, 0) AS n_pos, sp,
  sum(sq) OVER (PARTITION BY r.run_id) AS sq, sum(n) OVER (PARTITION BY r.run_id) AS total
  FROM (SELECT DISTINCT run_id FROM bins) r CROSS JOIN range(0, 10) k(bin)
  LEFT JOIN bins ON bins.run_id = r.run_id AND bins.bin = k.bin)"""


@query(
    "reliability",
    sql(
        f"""SELECT run_id, bin, cast(bin AS double) / 10.0::double AS edge_low,
  cast(bin + 1 AS double) / 10.0::double AS edge_high, n AS n_pixels,
  round(sp / nullif(n, 0), 9) AS mean_probability, {ratio_sql('n_pos', 'n')} AS vessel_fraction,
  round(sq / cast(total AS double), 9) AS pooled_brier FROM filled""",
        "scored_runs",
    ).replace("\nSELECT run_id, bin, cast", f",\n{BINNED}\nSELECT run_id, bin, cast"),
)
def reliability(spark, sf):
    return r9(metrics.reliability(scored_runs(spark, sf), ["run_id"], 10), "mean_probability", "pooled_brier")


@query(
    "chart_reliability",
    sql(
        f"""SELECT run_id, bin, (cast(bin AS double) / 10.0::double + cast(bin + 1 AS double) / 10.0::double) / 2.0::double
  AS center, round(sp / n, 9) AS mean_probability, {ratio_sql('n_pos', 'n')} AS vessel_fraction, n AS n_pixels
FROM filled WHERE n > 0""",
        "scored_runs",
    ).replace("\nSELECT run_id, bin, (cast", f",\n{BINNED}\nSELECT run_id, bin, (cast"),
)
def chart_reliability(spark, sf):
    from maskaudit.plans.reports import chart_reliability as chart

    return r9(chart(metrics.reliability(scored_runs(spark, sf), ["run_id"], 10)), "mean_probability")


SWEEP = f"""binned AS (SELECT {ITEM_SQL}, {grid_sql('p', 100)} AS b, count(*) FILTER (label) AS v,
  count(*) FILTER (NOT label) AS n FROM (SELECT *, cast(prob AS double) AS p FROM SOURCE WHERE in_fov) GROUP BY ALL),
items AS (SELECT DISTINCT {ITEM_SQL} FROM binned),
sweep AS (SELECT i.run_id, i.dataset, i.image_id, i.fold, cast(g.k AS bigint) AS k,
  cast(g.k AS double) / 100.0::double AS threshold,
  cast(sum(v) FILTER (b >= g.k) AS bigint) AS tp0, cast(sum(n) FILTER (b >= g.k) AS bigint) AS fp0,
  cast(sum(v) FILTER (b < g.k) AS bigint) AS fn0
  FROM items i CROSS JOIN range(1, 100) g(k) JOIN binned USING ({ITEM_SQL}) GROUP BY ALL),
swept AS (SELECT {ITEM_SQL}, k, threshold, coalesce(tp0, 0) AS tp, coalesce(fp0, 0) AS fp, coalesce(fn0, 0) AS fn
  FROM sweep)"""


def _with(source: str, extra: str, body: str, *needs: str) -> str:
    return sql("", *needs).rstrip() + ",\n" + extra.replace("SOURCE", source) + "\n" + body


@query(
    "threshold_sweep",
    _with(
        "scored", SWEEP,
        f"SELECT *, {dice_sql('tp', 'fp', 'fn')} AS dice FROM swept", "scored",
    ),
)
def threshold_sweep(spark, sf):
    return metrics.threshold_sweep(scored(spark, sf), ITEM, 100)


@query(
    "best_threshold",
    _with(
        "tuning",
        f"""tuning AS (SELECT s.run_id, s.dataset, s.image_id, a.fold, s.prob, s.label, s.in_fov
  FROM scored s JOIN eval_assignments a ON a.run_id = s.run_id AND a.image_id = s.image_id AND a.role = 'val'),
{SWEEP},
means AS (SELECT run_id, fold, k, threshold, avg(dice) AS val_dice, count(*) AS n_images,
  sum(cast(floor(dice * 1e12::double + 0.5::double) AS bigint)) AS total
  FROM (SELECT *, {dice_sql('tp', 'fp', 'fn')} AS dice FROM swept) GROUP BY ALL)""",
        """SELECT run_id, fold, threshold, round(val_dice, 9) AS val_dice, n_images,
  'max mean per-image validation Dice over the grid i/100' AS selection_rule
FROM (SELECT *, row_number() OVER (PARTITION BY run_id, fold ORDER BY total DESC, k) AS rn FROM means) WHERE rn = 1""",
        "scored", "eval_assignments",
    ),
)
def best_threshold(spark, sf):
    val = eval_assignments(spark, sf).where("role = 'val' AND run_id = 'base'").select("run_id", "image_id", "fold")
    tuning = scored(spark, sf).drop("fold").join(val, ["run_id", "image_id"])
    sweep = metrics.threshold_sweep(tuning, ITEM, 100)
    return r9(metrics.best_threshold(sweep, ["run_id", "fold"], 100), "val_dice")


@query(
    "threshold_grid",
    sql(
        f"""SELECT g.run_id, cast(k AS bigint) AS k, cast(k AS double) / 20.0::double AS threshold,
  count(*) FILTER (label AND cast(prob AS double) >= k / 20.0::double) AS tp,
  count(*) FILTER (NOT label AND cast(prob AS double) >= k / 20.0::double) AS fp,
  count(*) FILTER (label AND cast(prob AS double) < k / 20.0::double) AS fn
FROM scored_runs g CROSS JOIN range(1, 20) t(k) WHERE in_fov GROUP BY g.run_id, k""",
        "scored_runs",
    ),
)
def threshold_grid(spark, sf):
    return metrics.grid_counts(scored_runs(spark, sf), ["run_id"], 20)


@query(
    "binarize",
    sql(
        f"""SELECT {ITEM_SQL}, row, col, cast(prob AS double) >= {FOLD_THRESHOLD_SQL} AS predicted
FROM scored""",
        "scored",
    ),
)
def binarize(spark, sf):
    return scored(spark, sf).select(
        *ITEM, "row", "col", S.is_positive(F.col("prob"), fold_threshold()).alias("predicted")
    )


@query(
    "outcome_map",
    sql(
        f"""SELECT {ITEM_SQL}, outcome, count(*) AS n FROM (SELECT *, CASE
  WHEN hit AND label AND in_fov THEN 'tp' WHEN hit AND NOT label AND in_fov THEN 'fp'
  WHEN NOT hit AND label AND in_fov THEN 'fn' ELSE 'rest' END AS outcome
  FROM (SELECT *, cast(prob AS double) >= {FOLD_THRESHOLD_SQL} AS hit FROM scored)) GROUP BY ALL""",
        "scored",
    ),
)
def outcome_map(spark, sf):
    hit = S.is_positive(F.col("prob"), fold_threshold())
    return (
        scored(spark, sf)
        .groupBy(*ITEM, S.outcome(hit, F.col("label"), F.col("in_fov")).alias("outcome"))
        .agg(F.count("*").alias("n"))
    )


@query(
    "score_validity",
    sql(
        """SELECT run_id, image_id, count(*) FILTER (prob IS NULL OR isnan(prob) OR NOT prob BETWEEN 0 AND 1) AS n_bad,
  cast(max(row) + 1 AS bigint) AS height, cast(max(col) + 1 AS bigint) AS width, count(*) AS n_pixels,
  count(*) = (max(row) + 1)::bigint * (max(col) + 1) AS is_full
FROM (SELECT run_id, image_id, row, col, cast(cast(prob AS double) * 1.01::double AS float) AS prob FROM scored)
GROUP BY ALL""",
        "scored",
    ),
)
def score_validity(spark, sf):
    wide = (F.col("prob").cast("double") * F.lit(1.01)).cast("float")
    return metrics.score_validity(scored(spark, sf).withColumn("prob", wide), ["run_id", "image_id"])


@query(
    "empty_masks",
    sql(
        "SELECT dataset, image_id, row FROM scored GROUP BY ALL HAVING count(*) FILTER (in_fov) = 0", "scored"
    ),
)
def empty_masks(spark, sf):
    return metrics.empty_masks(scored(spark, sf), ["dataset", "image_id", "row"])


# A digest level: values joined by commas in position order.
def _digest() -> str:
    out = ["""units0 AS (SELECT run_id, image_id, row::bigint * 64 + col AS p,
  cast(prob AS double) * 1073741824.0::double AS a, (a - floor(a)) * 1152921504606846976.0::double AS b,
  (b - floor(b)) * 1152921504606846976.0::double AS c,
  cast(floor(a) AS bigint) || '.' || cast(floor(b) AS bigint) || '.' || cast(floor(c) AS bigint) AS v FROM scored)"""]
    for i in range(1, 5):
        out.append(
            f"units{i} AS (SELECT run_id, image_id, p // 4096 AS p, sha256(string_agg(v, ',' ORDER BY p, v)) AS v"
            f" FROM units{i - 1} GROUP BY run_id, image_id, p // 4096)"
        )
    return ",\n".join(out)


DIGEST = _digest()


@query(
    "score_digest",
    _with(
        "scored", DIGEST,
        "SELECT run_id, image_id, sha256(string_agg(v, ',' ORDER BY p, v)) AS digest FROM units4 GROUP BY run_id, image_id",
        "scored",
    ),
)
def score_digest(spark, sf):
    position = F.col("row").cast("bigint") * 64 + F.col("col")
    return reconcile.score_digest(scored(spark, sf), ["run_id", "image_id"], position)


LOSS_ROWS = """SELECT run_id, fold, cast(label AS double) AS y, cast(prob AS double) AS p, cast(in_fov AS double) AS w
FROM scored_runs"""


def _loss_rows(spark, sf):
    return scored_runs(spark, sf).select(
        "run_id", "fold", F.col("label").cast("double").alias("y"),
        F.col("prob").cast("double").alias("p"), F.col("in_fov").cast("double").alias("w"),
    )


DICE_SQL = "1.0::double - (2.0::double * sum(w * y * p) + 1.0::double) / (sum(w * y) + sum(w * p) + 1.0::double)"
CLIP = "least(greatest(p, 1e-7::double), 1.0::double - 1e-7::double)"
BCE_SQL = f"sum(w * -(y * ln({CLIP}) + (1.0::double - y) * ln(1.0::double - {CLIP}))) / greatest(sum(w), 1.0::double)"


@query("soft_dice", sql(f"SELECT run_id, fold, round({DICE_SQL}, 9) AS loss FROM ({LOSS_ROWS}) GROUP BY ALL", "scored_runs"))
def soft_dice(spark, sf):
    return r9(losses.batch_loss(_loss_rows(spark, sf), ["run_id", "fold"], "dice"), "loss")


@query("masked_bce", sql(f"SELECT run_id, fold, round({BCE_SQL}, 9) AS loss FROM ({LOSS_ROWS}) GROUP BY ALL", "scored_runs"))
def masked_bce(spark, sf):
    rows = _loss_rows(spark, sf)
    return r9(rows.groupBy("run_id", "fold").agg(losses.masked_bce_expr().alias("loss")), "loss")


@query(
    "bce_dice",
    sql(f"SELECT run_id, fold, round({BCE_SQL} + {DICE_SQL}, 9) AS loss FROM ({LOSS_ROWS}) GROUP BY ALL", "scored_runs"),
)
def bce_dice(spark, sf):
    return r9(losses.batch_loss(_loss_rows(spark, sf), ["run_id", "fold"], "bce_dice"), "loss")


# ---------------------------------------------------------------- summaries across items

LONG = """long AS (SELECT run_id, image_id, metric, value FROM (UNPIVOT (SELECT run_id, image_id, METRICS FROM metrics)
  ON METRICS INTO NAME metric VALUE value))"""
SUMMARY_METRICS = ("dice", "sensitivity", "precision_score", "auc_roc", "auc_pr", "brier")


def long_sql(columns) -> str:
    return LONG.replace("METRICS", ", ".join(columns))


SPREAD = """count(*) AS n, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS sd,
  round(min(value), 9) AS minimum, round(max(value), 9) AS maximum, round(quantile_cont(value, 0.5), 9) AS median"""
SPREAD_COLUMNS = ("mean", "sd", "minimum", "maximum", "median")


@query(
    "metric_summary",
    _with("metrics", long_sql(SUMMARY_METRICS), f"SELECT run_id, metric, {SPREAD} FROM long GROUP BY ALL", "metrics"),
)
def metric_summary(spark, sf):
    values = stats.long_metrics(eval_metrics(spark, sf), ["run_id"], "image_id", SUMMARY_METRICS)
    return r9(stats.summarize(values, ["run_id", "metric"]), *SPREAD_COLUMNS)


@query(
    "item_quantiles",
    _with(
        "metrics", long_sql(("dice", "brier")),
        """SELECT run_id, metric, round(quantile_disc(value, 0.25), 9) AS q1, round(quantile_disc(value, 0.75), 9) AS q3
FROM long GROUP BY ALL""",
        "metrics",
    ),
)
def item_quantiles(spark, sf):
    values = stats.long_metrics(eval_metrics(spark, sf), ["run_id"], "image_id", ("dice", "brier"))
    wanted = {"q1": 0.25, "q3": 0.75}
    out = ranking.exact_quantiles(values, ["run_id", "metric"], "value", wanted, "inverted_cdf")
    return r9(out, "q1", "q3")


def bootstrap_sql(seed: int, resamples: int, level: float) -> str:
    from workload.bindings import draw_sql

    tail = (1 - level) / 2
    return f"""placed AS MATERIALIZED (SELECT run_id, metric, value,
  row_number() OVER (PARTITION BY run_id, metric ORDER BY {draw_sql(seed, 'position', 'image_id')}, image_id) - 1 AS pos,
  count(*) OVER (PARTITION BY run_id, metric) AS n FROM long),
drawn AS MATERIALIZED (SELECT cast(t.r AS integer) AS r, j, {draw_sql(seed, 'bootstrap', 't.r', 'j')} AS u
  FROM (SELECT DISTINCT pos AS j FROM placed), range(0, {resamples}) t(r)),
draws AS (SELECT run_id, metric, r, u % n AS pos FROM placed JOIN drawn ON pos = j),
means AS (SELECT d.run_id, d.metric, r, avg(value) AS m FROM draws d JOIN placed p
  ON p.run_id = d.run_id AND p.metric = d.metric AND p.pos = d.pos GROUP BY ALL),
ci AS (SELECT run_id, metric, round(quantile_cont(m, {tail!r}), 9) AS ci_low,
  round(quantile_cont(m, {1 - tail!r}), 9) AS ci_high FROM means GROUP BY ALL)"""


@query(
    "bootstrap_ci",
    _with(
        "metrics", long_sql(("dice", "auc_roc")) + ",\n" + bootstrap_sql(20260927, 10_000, 0.95),
        "SELECT * FROM ci", "metrics",
    ),
)
def bootstrap_ci(spark, sf):
    values = stats.long_metrics(eval_metrics(spark, sf), ["run_id"], "image_id", ("dice", "auc_roc"))
    out = stats.bootstrap_mean_ci(values, ["run_id", "metric"], "image_id", 10_000, 20260927, 0.95)
    return r9(out, "ci_low", "ci_high")
