"""Audits, rules, reconciliation and the Parquet registry: clean passes, and each fault found."""

# Expected numbers below that are not computed are worked by hand from the rows beside them.

import hashlib

import pytest
from pyspark.sql import functions as F

from maskaudit import schemas, session
from maskaudit.functions import scalars as S
from maskaudit.operators import audit, quality, reconcile
from maskaudit.plans import queries, reports
from maskaudit.sources import manifests, tables

T0, T1 = "2026-09-27T10:00:00Z", "2026-09-27T11:00:00Z"
DICE = {
    "base": {1: {"21": 0.8, "22": 0.6}, 2: {"23": 0.7}},
    "ablate": {1: {"21": 0.7, "22": 0.65}, 2: {"23": 0.9}},
    "open": {1: {"21": 0.1}},
}
VARIANTS = {"base": "baseline", "ablate": "dice_only", "open": "baseline"}
AREAS = {"21": (0.9, 0.8, 0.05, 0.6, None), "22": (0.8, 0.7, 0.07, 0.4, 0.9)}
CONFIG = '{"folds": {"n_folds": 2}, "training": {"deterministic_ops": true}}'


def frame(spark, name, rows):
    schema = tables.table_schema(name)
    full = [tuple(r.get(c) for c in schema.names) for r in rows]
    return spark.createDataFrame(full, schema)


def fixture(spark):
    runs, metrics, assigned, thresholds, history, status = [], [], [], [], [], []
    for run, per_fold in DICE.items():
        runs.append(
            {"run_id": run, "variant": VARIANTS[run], "config": CONFIG, "git_commit": "c", "git_dirty": False,
             "git_tag": "v1.0.0", "data_hash": "data", "config_hash": "hash", "seed": 1, "python_version": "3.13",
             "tensorflow_version": "2.21", "device": "gpu", "gpu_type": "T4", "compute_platform": "lab",
             "deterministic_ops": True, "started_at": T0, "finished_at": None if run == "open" else T1,
             "is_reported": False}
        )
        for fold, images in per_fold.items():
            thresholds.append({"run_id": run, "fold": fold, "threshold": {1: 0.4, 2: 0.55}[fold],
                               "selection_rule": "rule", "val_dice": 0.8})
            for epoch, dice in enumerate((0.4, 0.8, 0.8, 0.8 / 3), 1):
                history.append({"run_id": run, "fold": fold, "epoch": epoch, "train_loss": 1.0, "val_dice": dice})
            status.append({"run_id": run, "fold": fold, "status": "complete", "checkpoint_sha256": f"{run}{fold}",
                           "started_at": T0, "completed_at": T1, "attempts": 1})
            for image in ("21", "22", "23"):
                assigned.append({"run_id": run, "fold": fold, "dataset": "drive", "image_id": image,
                                 "role": "test" if image in images else "train"})
            for image, dice in images.items():
                a = AREAS.get(image, (None,) * 5) if run == "base" else (None,) * 5
                metrics.append(
                    {"run_id": run, "dataset": "drive", "image_id": image, "fold": fold, "prediction_mode": "single",
                     "dice": dice, "sensitivity": dice, "specificity": 0.9, "precision_score": 0.5, "accuracy": 0.95,
                     "auc_roc": a[0], "auc_pr": a[1], "brier": a[2], "thin_sensitivity": a[3], "thick_sensitivity": a[4]}
                )
    images = [
        {"dataset": "drive", "image_id": i, "split": "training", "has_abnormality": i == "23",
         "abnormality_note": "note" if i == "23" else None, "fov_pixels": 10, "fov_source": "official",
         "vessel_fraction_in_fov": 0.1, "has_labels": True}
        for i in ("21", "22", "23")
    ]
    rows = {"runs": runs, "per_image_metrics": metrics, "fold_assignments": assigned, "thresholds": thresholds,
            "training_history": history, "fold_status": status, "images": images}
    return {name: frame(spark, name, r) for name, r in rows.items()}


@pytest.fixture(scope="module")
def t(spark):
    return {name: df.cache() for name, df in fixture(spark).items()}


def test_fold_summary(t):
    rows = {(r.run_id, r.fold): r for r in queries.run_query(t, "01_fold_summary").collect()}
    assert set(rows) == {("base", 1), ("base", 2), ("ablate", 1), ("ablate", 2)}
    r = rows["base", 1]
    assert (r.n_images, r.n_evaluated) == (2, 2)
    assert r.mean_dice == pytest.approx(0.7) and r.mean_auc_roc == pytest.approx(0.85)
    assert r.mean_thin_sensitivity == pytest.approx(0.5) and r.mean_thick_sensitivity == 0.9
    assert rows["base", 2].n_evaluated == 0 and rows["base", 2].mean_auc_roc is None


def test_worst_images(t):
    out = queries.run_query(t, "02_worst_images").collect()
    base = sorted((r.dice_rank, r.image_id) for r in out if r.run_id == "base")
    assert base == [(1, "22"), (2, "23"), (3, "21")]
    assert "open" not in {r.run_id for r in out}


def test_variant_comparison(t):
    out = queries.run_query(t, "03_variant_comparison").collect()
    assert [(r.image_id, round(r.delta_dice, 9)) for r in out] == [("21", -0.1), ("22", 0.05), ("23", 0.2)]
    assert all(r.delta_auc_pr is None for r in out)
    moved = t["fold_assignments"].withColumn(
        "role", F.when((F.col("run_id") == "ablate") & (F.col("image_id") == "21"), "val").otherwise(F.col("role"))
    )
    assert queries.variant_comparison({**t, "fold_assignments": moved}, "drive").isEmpty()
    data = t["runs"].withColumn("data_hash", F.col("run_id"))
    assert queries.variant_comparison({**t, "runs": data}, "drive").isEmpty()


def test_threshold_log(t):
    out = queries.run_query(t, "05_threshold_log").collect()
    assert {(r.best_epoch, r.n_epochs) for r in out} == {(2, 4)}
    assert {r.run_id: r.is_finished for r in out} == {"base": True, "ablate": True, "open": False}
    with pytest.raises(KeyError):
        queries.run_query(t, "06_missing")


def test_leakage_audit(spark, t):
    clean = t["fold_assignments"]
    assert audit.leakage_audit(clean).isEmpty()
    extra = [
        {"run_id": "base", "fold": 1, "dataset": "drive", "image_id": "23", "role": "val"},
        {"run_id": "base", "fold": 2, "dataset": "drive", "image_id": "21", "role": "test"},
    ]
    out = audit.leakage_audit(clean.unionByName(frame(spark, "fold_assignments", extra))).collect()
    assert sorted((r.image_id, r.problem, r.detail) for r in out) == [
        ("21", "more than one role in fold 2", "test,train"),
        ("21", "test in more than one fold", "1,2"),
        ("23", "more than one role in fold 1", "train,val"),
    ]


def reportability(t, spark, **changes):
    parts = {
        **t,
        "evaluations": spark.createDataFrame([("base", "c", False)], "run_id string, commit string, dirty boolean"),
        "artifacts": t["fold_status"].select("run_id", "fold", F.col("checkpoint_sha256").alias("digest")),
        "hashes": spark.createDataFrame([("drive", "data")], "dataset string, data_hash string"),
        **changes,
    }
    out = audit.reportability(
        parts["runs"].where("run_id = 'base'"), parts["fold_status"], parts["fold_assignments"],
        parts["per_image_metrics"].withColumn("brier", F.coalesce("brier", F.lit(0.1))), parts["images"],
        parts["evaluations"], parts["artifacts"], parts["hashes"], gpu_type="T4", platform="lab",
    )
    return sorted(r.rule for r in out.collect())


def test_a_clean_run_is_reportable(spark, t):
    assert reportability(t, spark) == []


@pytest.mark.parametrize(
    "name, change, rule",
    [
        ("runs", lambda d: d.withColumn("git_dirty", F.lit(True)), "dirty tree"),
        ("runs", lambda d: d.withColumn("git_tag", F.lit(None).cast("string")), "no tag"),
        ("runs", lambda d: d.withColumn("finished_at", F.lit(None).cast("string")), "unfinished"),
        ("runs", lambda d: d.withColumn("gpu_type", F.lit("cpu")), "hardware"),
        ("runs", lambda d: d.withColumn("deterministic_ops", F.lit(False)), "determinism"),
        ("runs", lambda d: d.withColumn("data_hash", F.lit("x")), "data hash"),
        ("runs", lambda d: d.withColumn("git_commit", F.lit("d")), "evaluation"),
        ("fold_status", lambda d: d.withColumn("checkpoint_sha256", F.lit("x")), "checkpoint"),
        ("per_image_metrics", lambda d: d.where("image_id <> '22'"), "partly evaluated"),
        ("per_image_metrics", lambda d: d.unionByName(
            d.where("run_id = 'base' AND image_id = '21'").withColumn("image_id", F.lit("99"))), "rows for untested"),
        ("images", lambda d: d.unionByName(d.limit(1).withColumn("image_id", F.lit("40"))), "never tested"),
    ],
)
def test_each_fault_fails_its_rule(spark, t, name, change, rule):
    changed = {name: change(t[name])}
    if name == "fold_status":
        changed["artifacts"] = t[name].select("run_id", "fold", F.col("checkpoint_sha256").alias("digest"))
    found = reportability(t, spark, **changed)
    assert set(found) == {rule}


@pytest.mark.parametrize(
    "table, column, value, rule",
    [
        ("images", "dataset", "'other'", "dataset_enum"),
        ("images", "fov_pixels", "0L", "fov_pixels_min"),
        ("images", "abnormality_note", "''", "abnormal_iff_note"),
        ("images", "has_labels", "false", "fraction_needs_labels"),
        ("runs", "started_at", "'2026-09-27T10:00:00+02:00'", "started_at_format"),
        ("runs", "finished_at", "'2026-02-30T10:00:00Z'", "finished_at_format"),
        ("runs", "applied_threshold", "0.5D", "model_and_threshold_together"),
        ("runs", "device", "cast(NULL AS string)", "device_not_null"),
        ("fold_assignments", "role", "'dev'", "role_enum"),
        ("fold_status", "completed_at", "cast(NULL AS string)", "complete_needs_outputs"),
        ("thresholds", "threshold", "1.5D", "threshold_unit"),
        ("per_image_metrics", "dice", "-0.1D", "dice_unit"),
        ("training_history", "train_loss", "cast(NULL AS double)", "train_loss_not_null"),
    ],
)
def test_rules_name_each_violation(t, table, column, value, rule):
    keys = schemas.KEYS[table]
    assert quality.violations(t[table], keys, schemas.rules(table)).isEmpty()
    broken = quality.violations(t[table].withColumn(column, F.expr(value)), keys, schemas.rules(table))
    assert {r.rule for r in broken.collect()} == {rule}


def test_keys_and_references(t):
    for name, df in t.items():
        assert quality.duplicate_keys(df, schemas.KEYS[name]).isEmpty()
    assert reports.dangling_references(t).isEmpty()
    lost = {**t, "images": t["images"].where("image_id <> '21'")}
    assert {r.key for r in reports.dangling_references(lost).collect()} == {"drive/21"}


def test_latest_status_and_visible_rows(spark, t):
    again = frame(spark, "fold_status", [
        {"run_id": "base", "fold": 1, "status": "running", "started_at": T1, "attempts": 2}])
    latest = audit.latest_status(t["fold_status"].unionByName(again))
    row = latest.where("run_id = 'base' AND fold = 1").first()
    assert (row.status, row.attempts) == ("running", 2)
    seen = audit.rows_of_complete_folds(t["per_image_metrics"].where("run_id = 'base'"), latest)
    assert [r.image_id for r in seen.collect()] == ["23"]
    state = {r.run_id: r.can_finish for r in audit.finishable_runs(t["runs"], latest).collect()}
    assert state == {"base": False, "ablate": True, "open": True}


def test_early_stopping_needs_a_strict_gain(spark):
    dice = [0.4, 0.8, 0.8, 0.7, 0.9]
    rows = [{"run_id": "r", "fold": 1, "epoch": i, "train_loss": 1.0, "val_dice": d} for i, d in enumerate(dice, 1)]
    out = audit.early_stop_trace(frame(spark, "training_history", rows), 2).orderBy("epoch").collect()
    assert [r.improved for r in out] == [True, True, False, False, True]
    assert [r.stop for r in out] == [False, False, False, True, False]
    assert [r.trained for r in out] == [True] * 4 + [False]


def test_registry_round_trip(spark, t, tmp_path):
    root = str(tmp_path / "registry")
    first = t["images"].where("image_id <> '23'")
    tables.append(first, root, "images")
    assert tables.append_new(t["images"], root, "images") == 1
    assert tables.append_new(t["images"], root, "images") == 0
    again = t["images"].where("image_id <> '23'").withColumn("image_id", F.concat(F.lit("n"), "image_id"))
    assert tables.append_new(again.unionByName(again), root, "images") == first.count()
    with pytest.raises(ValueError, match="each other"):
        tables.append_new(again.unionByName(again.withColumn("fov_pixels", F.lit(11))), root, "images")
    with pytest.raises(ValueError, match="differ"):
        tables.append_new(t["images"].withColumn("fov_pixels", F.lit(11)), root, "images")
    with pytest.raises(ValueError, match="missing"):
        tables.append(first.drop("split"), root, "images")
    problem = spark.createDataFrame([("a", "missing")], "path string, problem string")
    with pytest.raises(ValueError, match="manifest"):
        tables.insert_runs(t["runs"], problem, root)
    tables.insert_runs(t["runs"], problem.where("false"), root)
    assert tables.read_table(spark, root, "runs").count() == 3


def test_folds_start_complete_and_fill(spark, t, tmp_path):
    root = str(tmp_path / "registry")
    one = "run_id = 'base' AND fold = 1"
    spark.createDataFrame([], tables.table_schema("fold_status")).write.parquet(tables.table_path(root, "fold_status"))
    wanted = spark.createDataFrame([("base", 1)], "run_id string, fold int")
    tables.start_folds(wanted, T0, root)
    tables.start_folds(wanted, T1, root)
    state = audit.latest_status(tables.read_table(spark, root, "fold_status")).first()
    assert (state.status, state.attempts) == ("running", 2)
    done = t["fold_status"].where(one).withColumn("attempts", F.lit(2))
    parts = {n: t[n].where(one) for n in ("thresholds", "training_history", "per_image_metrics")}
    with pytest.raises(ValueError, match="history"):
        tables.complete_fold({**parts, "training_history": parts["training_history"].where("false")}, done, root)
    tables.complete_fold(parts, done, root)
    # An attempt that died has left its rows; only those of the one that completed are seen.
    for name in parts:
        tables._write(tables.conform(parts[name], name).withColumn("attempt", F.lit(1)), root, name)
        assert tables.read_visible(spark, root, name).count() == parts[name].count()
        assert tables.read_table(spark, root, name).count() == 2 * parts[name].count()
    with pytest.raises(ValueError, match="cannot start"):
        tables.start_folds(wanted, T1, root)
    with pytest.raises(ValueError, match="running"):
        tables.complete_fold(parts, done, root)
    records = spark.createDataFrame(
        [("base", "drive", "21", "single", 0.33)],
        "run_id string, dataset string, image_id string, prediction_mode string, brier double",
    )
    tables.write_evaluation(records, root, ["brier"])
    out = {r.image_id: r.brier for r in tables.read_table(spark, root, "per_image_metrics").collect()}
    assert out == {"21": 0.33, "22": 0.07}
    with pytest.raises(ValueError, match="single stored row"):
        tables.write_evaluation(records.withColumn("image_id", F.lit("99")), root, ["brier"])


def test_snapshot_holds_reported_runs_only(spark, t, tmp_path):
    out = str(tmp_path / "release")
    with pytest.raises(ValueError, match="release tag"):
        tables.write_snapshot(t, out, "latest")
    with pytest.raises(ValueError, match="no reported"):
        tables.write_snapshot(t, out, "v1.0.0")
    reported = {**t, "runs": t["runs"].withColumn("is_reported", F.col("run_id") == "base")}
    tables.write_snapshot(reported, out, "v1.0.0")
    assert spark.read.parquet(f"{out}/v1.0.0/per_image_metrics").count() == 3
    assert spark.read.parquet(f"{out}/v1.0.0/images").count() == 3
    with pytest.raises(Exception, match="(?i)exist"):
        tables.write_snapshot(reported, out, "v1.0.0")


def test_manifests(spark, tmp_path):
    data = tmp_path / "data"
    (data / "sub").mkdir(parents=True)
    (data / "a.txt").write_text("a")
    (data / "sub" / "b.txt").write_text("b")
    (data / ".hidden").write_text("x")
    digests = manifests.file_digests(spark, str(data), "D")
    want = {"D/a.txt": hashlib.sha256(b"a").hexdigest(), "D/sub/b.txt": hashlib.sha256(b"b").hexdigest()}
    assert {r.path: r.digest for r in digests.collect()} == want
    assert {r.path for r in manifests.list_files(spark, str(data), "D").collect()} == set(want)
    path = str(tmp_path / "manifest")
    with pytest.raises(FileNotFoundError):
        manifests.check_or_write(spark, path, digests, exists=False)
    assert manifests.check_or_write(spark, path, digests, exists=False, write_missing=True).isEmpty()
    (data / "a.txt").write_text("changed")
    (data / "c.txt").write_text("c")
    spark.catalog.clearCache()
    out = manifests.check_or_write(spark, path, manifests.file_digests(spark, str(data), "D"), exists=True)
    assert {(r.path, r.problem) for r in out.collect()} == {("D/a.txt", "mismatched"), ("D/c.txt", "unlisted")}
    flat = reconcile.data_hash(manifests.read_manifest(spark, path).withColumn("g", F.lit(1)), ["g"]).first()
    level = [(hashlib.md5(p.encode()).hexdigest(), p, f"{d}  {p}\n") for p, d in want.items()]
    for digits in (8, 6, 4, 2, 0):
        parts = {k[:digits]: sorted((o, t) for kk, o, t in level if kk[:digits] == k[:digits]) for k, _, _ in level}
        level = [(k, k, hashlib.sha256("".join(t for _, t in rows).encode()).hexdigest()) for k, rows in parts.items()]
    assert (flat.n_lines, flat.data_hash) == (2, level[0][2])


def test_scalar_rules(spark):
    row = spark.range(1).select(
        S.format_na(F.lit(0.12345), 3), S.format_na(F.lit(1.0), 3), S.format_na(F.lit(None).cast("double"), 3),
        S.minutes_between(F.lit(T0), F.lit("2026-09-27T10:02:30Z")), S.padded_id(F.lit(3)),
        S.is_release_tag(F.lit("v0.1.0-rc.1")), S.is_release_tag(F.lit("v0.1")),
        S.grid_index(F.lit(0.29), 100), S.grid_index(F.lit(0.57), 100), S.reliability_bin(F.lit(1.0), 10),
    ).first()
    assert tuple(row) == ("0.123", "1.000", "NA", 2, "03", True, False, 29, 57, 9)


def test_markdown_sink(spark, t, tmp_path):
    path = str(tmp_path / "per_image")
    report = reports.per_image(t, "drive").where("run_id = 'base'")
    reports.write_markdown(report, ["image_id", "fold", "dice", "auc_roc"], ["image_id"], path, "Runs: base.")
    lines = [r.value for r in spark.read.text(path).collect()]
    assert "| 21 | 1 | 0.800 | 0.900 |" in lines and "| 23 | 2 | 0.700 | NA |" in lines
    assert "Runs: base." in lines and "| image_id | fold | dice | auc_roc |" in lines


def test_scores_are_saved_digested_and_summarised(spark, tmp_path):
    root = str(tmp_path / "registry")
    rows = [{"run_id": "r", "dataset": "drive", "image_id": "1", "fold": 1, "row": i // 2, "col": i % 2, "prob": p,
             "label": True, "in_fov": True} for i, p in enumerate([0.0, 1e-9, 3e-10, 1.0])]
    scored = frame(spark, "scored_pixels", rows)
    tables.save_scores(scored, root)
    stored = tables.read_table(spark, root, "scored_pixels")
    digest = tables.score_digests(stored, F.lit(2)).first().digest
    assert digest == tables.score_digests(scored.repartition(3), F.lit(2)).first().digest
    for low in (0.0, 3e-10):
        other = scored.withColumn("prob", F.when(F.col("prob") == F.lit(1e-9).cast("float"), F.lit(low)).otherwise(F.col("prob")).cast("float"))
        assert tables.score_digests(other, F.lit(2)).first().digest != digest
    summary = spark.createDataFrame([("r", [(1, 0.5)])], "run_id string, folds array<struct<fold:int,dice:double>>")
    tables.write_summary(summary, str(tmp_path / "summary"))
    assert tables.read_summary(spark, str(tmp_path / "summary"), summary.schema.simpleString()[7:-1].replace("run_id:", "run_id ").replace("folds:", "folds ")).collect() == summary.collect()


def test_unknown_datasets_are_an_error(spark):
    files = spark.createDataFrame([("drive/a", "1"), ("stare/b", "2")], "path string, digest string")
    assert reconcile.verify_checksums(files, files, ["drive"]).isEmpty()
    with pytest.raises(ValueError, match="chase"):
        reconcile.verify_checksums(files, files, ["drive", "chase"])


def test_configs_hash_alike_in_any_order_and_apart_by_type(spark):
    texts = ['{"a": {"x": 1, "y": 2}, "b": 1}', '{"b":1,"a":{"y":2,"x":1}}', '{"a": "1,b=2"}', '{"a": "1", "b": "2"}', '{"a": 1, "b": 2}']
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, config string")
    got = {r.k: r.config_hash for r in reconcile.config_hash(rows, "k", "config").collect()}
    assert got[0] == got[1] and len(set(got.values())) == 4


def test_a_missing_value_breaks_a_rule(spark, t):
    bare = t["runs"].where("run_id = 'base'").withColumns(
        {"config": F.lit("{}"), "gpu_type": F.lit(None).cast("string"), "git_dirty": F.lit(None).cast("boolean")}
    )
    broken = {r.rule for r in audit.run_rules(bare, audit.latest_status(t["fold_status"]), "Tesla T4", "colab").collect()}
    assert {"unfinished", "dirty tree", "hardware", "determinism"} <= broken


def test_best_and_worst_refuse_short_runs(spark):
    rows = spark.createDataFrame([("a", str(i), i / 10) for i in range(4)], "run_id string, image_id string, dice double")
    got = reports.best_and_worst(rows, 2).collect()
    assert sorted((r.side, r.place, r.image_id) for r in got) == [("best", 1, "3"), ("best", 2, "2"), ("worst", 1, "0"), ("worst", 2, "1")]
    with pytest.raises(Exception, match="a has fewer than 6 images"):
        reports.best_and_worst(rows, 3).collect()


def test_a_task_reduces_a_bounded_number_of_assignments(spark, monkeypatch):
    monkeypatch.setattr(audit, "MARKS", 100)
    rows = spark.range(2000).select(
        F.concat(F.lit("r"), (F.col("id") % 50).cast("string")).alias("run_id"), F.lit("drive").alias("dataset"),
        F.col("id").cast("string").alias("image_id"), F.lit(1).alias("fold"), F.lit("test").alias("role"),
    )
    kept = rows.select("run_id", "dataset", "image_id", F.lit("single").alias("prediction_mode"), F.lit(0.5).alias("brier"))
    images = rows.select("dataset", "image_id", F.lit(True).alias("has_labels"))
    out = audit.image_state(rows, kept, images)
    assert {(r.n_tested, r.n_evaluated, r.n_labelled, r.n_leaks) for r in out.collect()} == {(40, 40, 40, 0)}
    assert "REPARTITION_BY_NUM" in (plan := out._jdf.queryExecution().executedPlan().toString())
    assert "image_id" in plan and ", 21), REPARTITION_BY_NUM" in plan


def test_rules_are_worked_out_once_per_row(spark):
    df = spark.range(5).select("id", F.concat(F.lit("soon"), F.col("id").cast("string")).alias("at"))
    rules = {"format": S.timestamp_ok(F.col("at")), "low": F.col("id") < 3, "even": F.col("id") % 2 == 0}
    out = quality.violations(df, ["id"], rules)
    got = sorted((r.id, r.rule) for r in out.collect())
    assert got == sorted([(i, "format") for i in range(5)] + [(3, "low"), (4, "low"), (1, "even"), (3, "even")])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("gettimestamp") == 1


def test_a_task_groups_a_bounded_number_of_stored_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    stored = spark.range(2000).select((F.col("id") % 1999).alias("image_id"), F.lit("r").alias("run_id"))
    records = spark.createDataFrame([("r", 0), ("r", 1), ("r", 5000), ("r", 5000), (None, 1)], "run_id string, image_id bigint")
    out = reconcile.unfillable(stored, records, ["run_id", "image_id"])
    assert sorted(map(tuple, out.collect()), key=str) == sorted([("r", 0, 2), ("r", 5000, 0), ("r", 5000, 0), (None, 1, 0)], key=str)
    assert ", 21), REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()


def test_a_task_groups_a_bounded_number_of_references(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    parents = spark.range(1000).select(F.col("id").alias("k"))
    children = spark.range(1000).select((F.col("id") + 10).alias("p")).unionByName(spark.createDataFrame([(None,)], "p bigint"))
    out = quality.unreferenced(children, parents, ["p"], ["k"])
    assert sorted(r.p for r in out.collect()) == list(range(1000, 1010))
    assert ", 21), REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
