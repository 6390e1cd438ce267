"""A stored run evaluated from end to end: gates, exact reproduction, filled rows and the summary."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskaudit.operators import audit, losses, metrics
from maskaudit.plans import evaluation, reports
from maskaudit.sources import tables

T0 = "2026-01-01T00:00:00Z"
SIDE = 12


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(3)
    truth, scored = [], []
    for k in range(4):
        label = np.zeros((SIDE, SIDE), dtype=bool)
        label[2:4, 1:11] = True
        label[6 : 9 + k % 2, 2 : 6 + k] = True
        prob = np.clip(label * 0.5 + rng.random((SIDE, SIDE)) * 0.5, 0, 1).astype(np.float32)
        for r in range(SIDE):
            for c in range(SIDE):
                row = ("drive", f"i{k}", r, c, bool(label[r, c]), r > 0)
                truth.append(row)
                for run in ("clean", "dirty"):
                    scored.append((run, *row[:2], k % 2 + 1, r, c, float(prob[r, c]), *row[4:]))
    truth = spark.createDataFrame(truth, "dataset string, image_id string, row int, col int, label boolean, in_fov boolean")
    scored = spark.createDataFrame(
        scored, "run_id string, dataset string, image_id string, fold int, row int, col int, prob float, label boolean, in_fov boolean"
    )
    runs = spark.createDataFrame(
        [("clean", "c1", False, "data", T0), ("dirty", "c0", True, "data", T0)],
        "run_id string, git_commit string, git_dirty boolean, data_hash string, finished_at string",
    ).withColumn("config", F.lit('{"folds": {"n_folds": 2}}'))
    folds = spark.createDataFrame([(r, f) for r in ("clean", "dirty") for f in (1, 2)], "run_id string, fold int")
    thresholds = folds.withColumn("threshold", F.col("fold") * 0.25)
    roles = [(r, f, "drive", f"i{k}", "test" if k % 2 + 1 == f else "train") for r in ("clean", "dirty") for f in (1, 2) for k in range(4)]
    items = metrics.evaluate_items(
        evaluation.with_thresholds(scored, thresholds), ["run_id", "dataset", "image_id", "fold", "threshold"], F.col("threshold")
    )
    none = F.lit(None).cast("double")
    wide = {c: none for c in ("mean_uncertainty", "uncertainty_error_auc", *evaluation.FILLED)}
    stored = items.select(
        "run_id", "dataset", "image_id", "fold", F.lit("single").alias("prediction_mode"), "dice", "sensitivity", "specificity",
        "precision_score", "accuracy", "predicted_vessel_fraction", *[v.alias(k) for k, v in wide.items()],
    )
    t = {
        "runs": runs, "thresholds": thresholds, "per_image_metrics": stored.persist(),
        "fold_status": folds.select("*", F.lit("complete").alias("status"), F.lit(1).alias("attempts")),
        "fold_assignments": spark.createDataFrame(roles, "run_id string, fold int, dataset string, image_id string, role string"),
    }
    return t, scored, truth


def evaluated(world, **changes):
    t, scored, truth = world
    code = {"commit": "c1", "dirty": False, "data_hash": "data", "bins": 5, "quantile": 0.5}
    code |= {k: changes.pop(k) for k in list(changes) if k in code}
    scored = changes.pop("scored", scored)
    return evaluation.evaluate_runs({**t, **changes}, scored, truth, **code)


def refused(e):
    return sorted((r["run_id"], r["rule"]) for r in e.refusals.collect())


def test_a_clean_and_a_dirty_run_are_evaluated(world):
    e = evaluated(world)
    assert refused(e) == []
    rows = e.filled.collect()
    assert len(rows) == 8 and all(r["brier"] is not None and r["thin_sensitivity"] is not None for r in rows)
    folds = {(r.run_id, r.fold): r for r in e.folds.collect()}
    assert {k: r.threshold for k, r in folds.items()} == {(r, f): f * 0.25 for r in ("clean", "dirty") for f in (1, 2)}
    assert all(r.n_thin + r.n_thick > 0 for r in folds.values())
    bins = e.reliability.where("run_id = 'clean'").collect()
    assert len(bins) == 5 and sum(b.n_pixels for b in bins) == 4 * SIDE * (SIDE - 1)


@pytest.mark.parametrize(
    "change, want",
    [
        ({"commit": "c9"}, [("clean", "other code")]),
        ({"dirty": True}, [("clean", "other code")]),
        ({"data_hash": "new"}, [("clean", "other data"), ("dirty", "other data")]),
    ],
)
def test_the_checkout_and_the_data_are_gates(world, change, want):
    assert refused(evaluated(world, **change)) == want


def test_each_fault_refuses_its_run_only(world):
    t, scored, _ = world
    clean = F.col("run_id") == "clean"
    bad = scored.withColumn("prob", F.when(clean & (F.col("row") == 3) & (F.col("image_id") == "i1"), F.lit(float("nan"))).otherwise(F.col("prob")).cast("float"))
    faults = {
        "scores": {"scored": bad},
        "not reproduced": {"per_image_metrics": t["per_image_metrics"].withColumn("dice", F.when(clean, F.col("dice") * 0.5).otherwise(F.col("dice")))},
        "not finished": {"fold_status": t["fold_status"].where(~(clean & (F.col("fold") == 2)))},
        "no threshold": {"thresholds": t["thresholds"].where(~(clean & (F.col("fold") == 2)))},
    }
    for rule, change in faults.items():
        found = refused(evaluated(world, **change))
        assert ("clean", rule) in found and {r for r, _ in found} == {"clean"}
    e = evaluated(world, scored=bad)
    assert {r["run_id"] for r in e.records.collect()} == {r["run_id"] for r in e.summary.collect()} == {"dirty"}


def test_an_evaluation_is_stored_whole_or_not_at_all(spark, world, tmp_path):
    t, _, _ = world
    root = str(tmp_path / "registry")
    status = t["fold_status"].select(
        "run_id", "fold", "status", F.lit("x").alias("checkpoint_sha256"), F.lit(T0).alias("started_at"), F.lit(T0).alias("completed_at"), "attempts"
    )
    tables.append(status, root, "fold_status")
    tables.append(t["per_image_metrics"], root, "per_image_metrics")
    with pytest.raises(ValueError, match="clean: other code"):
        evaluation.store_evaluation(evaluated(world, commit="c9"), ["clean", "dirty"], root, f"{tmp_path}/summary")
    assert tables.read_table(spark, root, "per_image_metrics").where("brier IS NOT NULL").count() == 0
    e = evaluated(world)
    evaluation.store_evaluation(e, ["clean"], root, f"{tmp_path}/summary")
    filled = tables.read_table(spark, root, "per_image_metrics").where("brier IS NOT NULL")
    assert {r.run_id for r in filled.collect()} == {"clean"} and filled.count() == 4
    text = spark.read.text(f"{tmp_path}/summary").collect()
    summary = json.loads(text[0]["value"])
    assert len(text) == 1 and summary["run_id"] == "clean" and summary["code"] == {"commit": "c1", "dirty": False}
    assert [f["fold"] for f in summary["folds"]] == [1, 2] and len(summary["reliability"]) == 5
    with pytest.raises(ValueError, match="nothing to evaluate"):
        evaluation.store_evaluation(e, ["clean", "gone"], root, f"{tmp_path}/again")


def test_a_target_keeps_its_loss(spark):
    rows = [(k % 2, float(k % 3 == 0), 1.0, 0.1 * k) for k in range(8)]
    df = spark.createDataFrame(rows, "b int, y double, w double, p double")
    packed = losses.pack_target(df).select("b", "p", "target.y", "target.w")
    loss = {r.b: r.loss for r in losses.batch_loss(df, ["b"], "bce_dice").collect()}
    assert {r.b: r.loss for r in losses.batch_loss(packed, ["b"], "bce_dice").collect()} == pytest.approx(loss)


def test_every_report_table_is_written_or_none(spark, world, tmp_path):
    t, _, _ = world
    e = evaluated(world)
    reported = t["runs"].select(
        "*", F.lit("baseline").alias("variant"), (F.col("run_id") == "clean").alias("is_reported"), F.lit("v1.0.0").alias("git_tag"),
        F.lit(T0).alias("started_at"), *[F.lit("x").alias(c) for c in ("gpu_type", "compute_platform", "python_version", "tensorflow_version", "cuda_version")],
        F.lit(True).alias("deterministic_ops"),
    )
    images = t["fold_assignments"].select("dataset", "image_id").distinct().withColumn("has_abnormality", F.col("image_id") == "i1")
    full = {
        **t, "runs": reported, "per_image_metrics": e.filled, "images": images.withColumn("vessel_fraction_in_fov", F.lit(0.2)),
        "thresholds": t["thresholds"].select("*", F.lit("best").alias("selection_rule"), F.lit(0.5).alias("val_dice")),
        "training_history": t["thresholds"].select("run_id", "fold", F.lit(1).alias("epoch"), F.lit(0.1).alias("train_loss"), F.lit(0.5).alias("val_dice")),
    }
    commits = spark.createDataFrame([("clean", "c1", False)], "run_id string, commit string, dirty boolean")
    made = reports.run_tables(full, "drive", e.folds.drop("threshold"), e.reliability, commits)
    assert set(made) == set(reports.RUN_TABLES)
    with pytest.raises(ValueError, match="not reported"):
        reports.write_run_tables(full, made, "dirty", str(tmp_path))
    reports.write_run_tables(full, made, "clean", str(tmp_path), "from clean")
    for name in reports.RUN_TABLES:
        lines = [r["value"] for r in spark.read.text(f"{tmp_path}/clean/{name}").collect()]
        assert lines[0].startswith("| ") and lines[-1] == "from clean" and len(lines) > 3
