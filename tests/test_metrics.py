"""Hand-worked metric values, NULL and tie rules, and brute-force equivalence."""

# Expected numbers below that are not computed are worked by hand from the rows beside them.

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskaudit.operators import losses, metrics

SCHEMA = "image_id string, row int, col int, prob float, label boolean, in_fov boolean"


def scored(spark, probs, labels, fov=None, image="a"):
    fov = fov or [1] * len(probs)
    rows = [(image, 0, i, float(p), bool(y), bool(f)) for i, (p, y, f) in enumerate(zip(probs, labels, fov))]
    return spark.createDataFrame(rows, SCHEMA)


def areas(df):
    row = metrics.rank_metrics(metrics.score_counts(df, ["image_id"]), ["image_id"]).first()
    return row["auc_roc"], row["auc_pr"]


def test_confusion_and_binary_metrics(spark):
    df = scored(spark, [1, 0, 1, 0, 0, 1], [1, 1, 0, 0, 0, 0], [1, 1, 1, 1, 1, 0])
    row = metrics.binary_metrics(metrics.confusion_counts(df, ["image_id"], F.lit(0.5))).first()
    assert (row.tp, row.fp, row.fn, row.tn) == (1, 1, 1, 2)
    assert row.dice == 0.5 and row.sensitivity == 0.5 and row.specificity == 2 / 3
    assert row.precision_score == 0.5 and row.accuracy == 3 / 5
    assert row.predicted_vessel_fraction == 2 / 5


def test_empty_label_and_prediction(spark):
    df = scored(spark, [0.1, 0.2], [0, 0])
    row = metrics.binary_metrics(metrics.confusion_counts(df, ["image_id"], F.lit(0.5))).first()
    assert row.dice == 1.0 and row.sensitivity is None and row.precision_score is None
    assert row.specificity == 1.0


def test_areas_and_brier(spark):
    df = scored(spark, [0.9, 0.8, 0.7, 0.1, 0.0], [1, 0, 1, 0, 1], [1, 1, 1, 1, 0])
    roc, pr = areas(df)
    assert roc == 0.75 and pr == pytest.approx(1 / 2 + 1 / 3)
    b = metrics.brier(df, ["image_id"]).first().brier
    assert b == pytest.approx((0.01 + 0.64 + 0.09 + 0.01) / 4)


@pytest.mark.parametrize(
    "probs, labels, want",
    [
        ([0.5, 0.5], [1, 0], (0.5, 0.5)),
        ([0.2, 0.6], [0, 0], (None, None)),
        ([0.2, 0.6], [1, 1], (None, 1.0)),
        ([1.0] * 6 + [0.0] + [0.5] * 65, [1] * 72, (None, 1.0)),
    ],
)
def test_area_edge_cases(spark, probs, labels, want):
    assert areas(scored(spark, probs, labels)) == want


def test_areas_against_pairs(spark):
    rng = np.random.default_rng(3)
    p = (rng.integers(0, 40, 300) / 40).astype(np.float32)
    y = rng.random(300) < p
    roc, pr = areas(scored(spark, p, y))
    pos, neg = p[y], p[~y]
    wins = (pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()
    assert roc == pytest.approx(wins / (len(pos) * len(neg)), abs=1e-12)
    precision = [(y[p >= t]).mean() for t in p[y]]
    assert pr == pytest.approx(np.mean(precision), abs=1e-12)


def test_pooled_areas_take_no_key(spark):
    df = scored(spark, [0.9, 0.8, 0.7, 0.1], [1, 0, 1, 0])
    row = metrics.rank_metrics(metrics.score_counts(df, []), []).first()
    assert row.auc_roc == 0.75


def test_double_scores_are_refused(spark):
    df = scored(spark, [0.5], [1]).withColumn("prob", F.col("prob").cast("double"))
    with pytest.raises(ValueError, match="must be float"):
        metrics.score_counts(df, ["image_id"])


def test_sweep_counts_equality_as_positive(spark):
    sweep = metrics.threshold_sweep(scored(spark, [0.5, 0.25], [1, 0]), ["image_id"], 4)
    assert [r.dice for r in sweep.orderBy("k").collect()] == [2 / 3, 1.0, 0.0]


def test_sweep_agrees_with_binarize_on_the_grid(spark):
    probs = [np.float32(i / 100) for i in range(1, 100)]
    df = scored(spark, probs, [i % 2 for i in range(99)])
    sweep = {r.k: (r.tp, r.fp) for r in metrics.threshold_sweep(df, ["image_id"], 100).collect()}
    for k in (1, 29, 57, 58, 99):
        c = metrics.confusion_counts(df, ["image_id"], F.lit(k / 100)).first()
        assert sweep[k] == (c.tp, c.fp)


def test_sweep_lists_every_threshold_and_no_task_groups_them(spark):
    df = scored(spark, [0.5, 0.25, 0.25], [1, 0, 1]).unionByName(scored(spark, [0.0], [1], image="b")).unionByName(
        scored(spark, [1.0, 0.0], [0, 1], image="c")
    )
    grid = metrics.grid_counts(df, ["image_id"], 4)
    assert sorted(tuple(r) for r in grid.collect()) == [
        ("a", 1, 0.25, 2, 1, 0), ("a", 2, 0.5, 1, 0, 1), ("a", 3, 0.75, 0, 0, 2),
        *[("b", k, k / 4, 0, 0, 1) for k in (1, 2, 3)], *[("c", k, k / 4, 0, 1, 1) for k in (1, 2, 3)],
    ]
    assert metrics.grid_counts(df.where("false"), [], 4).collect() == []
    assert [tuple(r) for r in metrics.grid_counts(df, [], 4).orderBy("k").collect()] == [
        (1, 0.25, 2, 2, 2), (2, 0.5, 1, 1, 3), (3, 0.75, 0, 1, 4),
    ]
    plan = grid._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan[plan.index("Window") :]  # the lines below a window are what it reads


def test_best_threshold_takes_the_lowest_of_a_tie(spark):
    df = scored(spark, [0.9, 0.6, 0.4, 0.1], [1, 1, 0, 0]).unionByName(
        scored(spark, [0.8, 0.7, 0.2, 0.1], [1, 1, 0, 0], image="b")
    ).withColumn("fold", F.lit(1))
    sweep = metrics.threshold_sweep(df, ["fold", "image_id"], 10)
    row = metrics.best_threshold(sweep, ["fold"], 10).first()
    assert (row.threshold, row.val_dice, row.n_images) == (0.5, 1.0, 2)
    assert row.selection_rule.endswith("i/10")


def test_reliability(spark):
    df = scored(spark, [0.05, 0.5, 1.0], [1, 0, 1]).unionByName(scored(spark, [0.5], [1], image="b"))
    rows = metrics.reliability(df, [], 4).orderBy("bin").collect()
    assert [r.n_pixels for r in rows] == [1, 0, 2, 1]
    assert rows[1].mean_probability is None and rows[1].vessel_fraction is None
    assert [rows[i].vessel_fraction for i in (0, 2, 3)] == [1.0, 0.5, 1.0]
    assert rows[0].pooled_brier == pytest.approx((0.95**2 + 0.5**2 + 0 + 0.5**2) / 4)
    with pytest.raises(ValueError, match="at least 2"):
        metrics.reliability(df, [], 1)


def test_evaluate_items_equals_the_single_metrics(spark):
    rng = np.random.default_rng(5)
    p, y, f = rng.random(200), rng.random(200) < 0.3, rng.random(200) < 0.8
    df = scored(spark, p, y, list(f))
    row = metrics.evaluate_items(df, ["image_id"], F.lit(0.4)).first()
    c = metrics.confusion_counts(df, ["image_id"], F.lit(0.4)).first()
    assert (row.tp, row.fp, row.fn, row.tn) == (c.tp, c.fp, c.fn, c.tn)
    assert row.brier == pytest.approx(metrics.brier(df, ["image_id"]).first().brier)
    assert (row.auc_roc, row.auc_pr) == pytest.approx(areas(df))


def test_evaluation_reads_the_pixels_once(spark, tmp_path):
    path = str(tmp_path / "scored")
    scored(spark, [0.1, 0.9], [0, 1]).write.parquet(path)
    df = metrics.evaluate_items(spark.read.parquet(path), ["image_id"], F.lit(0.5))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final
    assert "EqualTo(in_fov,true)" in final and "row" not in final.split("ReadSchema")[1].split(">")[0]
    assert "CartesianProduct" not in final and "NestedLoop" not in final


def test_losses(spark):
    rows = [(1.0, 0.5, 1.0), (0.0, 0.5, 1.0), (1.0, 0.9, 0.0), (0.0, 0.2, 0.0)]
    df = spark.createDataFrame(rows, "y double, p double, w double").withColumn("b", F.lit(1))
    assert losses.batch_loss(df, ["b"], "dice").first().loss == pytest.approx(1 - 2 / 3)
    assert losses.batch_loss(df, ["b"], "bce_dice").first().loss == pytest.approx(-math.log(0.5) + 1 / 3)
    one = spark.createDataFrame([(1.0, 0.25, 1.0)], "y double, p double, w double")
    assert one.agg(losses.masked_bce_expr()).first()[0] == pytest.approx(-math.log(0.25))
    none = spark.createDataFrame([(1.0, 0.25, 0.0)], "y double, p double, w double")
    assert none.agg(losses.masked_bce_expr()).first()[0] == 0
    with pytest.raises(ValueError, match="unknown loss"):
        losses.loss_expr("focal")


def test_invalid_scores_are_listed(spark):
    df = scored(spark, [0.5, float("nan"), 1.5], [1, 0, 0])
    row = metrics.score_validity(df, ["image_id"]).first()
    assert (row.n_bad, row.height, row.width, row.is_full) == (2, 1, 3, True)


@pytest.mark.parametrize("bad", [1.5, -0.1, float("nan"), None])
def test_invalid_scores_stop_the_job(spark, bad):
    rows = spark.createDataFrame([("a", 0.5, True, True), ("a", bad, False, True)], "item string, prob float, label boolean, in_fov boolean")
    outside = rows.withColumn("in_fov", F.col("prob") == 0.5)
    for measure in (
        lambda df: metrics.reliability(df, ["item"], 10), lambda df: metrics.threshold_sweep(df, ["item"], 10),
        lambda df: metrics.brier(df, ["item"]), lambda df: metrics.evaluate_items(df, ["item"], F.lit(0.5)),
    ):
        with pytest.raises(Exception, match="score outside"):
            measure(rows).collect()
        measure(outside).collect()
