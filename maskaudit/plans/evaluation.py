"""Evaluating stored runs from end to end: gates, recomputed metrics, areas, widths, calibration, filled rows, summary."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskaudit.functions import scalars as S
from maskaudit.operators import audit, metrics, reconcile, spatial
from maskaudit.operators.ranking import salted_lookup
from maskaudit.schemas import KEYS

Tables = Mapping[str, DataFrame]

IMAGE = ["run_id", "dataset", "image_id"]
#: What training stored and an evaluation must reproduce exactly.
STORED = ("fold", "dice", "sensitivity", "specificity", "precision_score", "accuracy")
#: What an evaluation fills in.
FILLED = ("auc_roc", "auc_pr", "brier", "thin_sensitivity", "thick_sensitivity")


@dataclass(frozen=True)
class Evaluation:
    """Plans of one evaluation; all but ``refusals`` cover the runs without a refusal only.

    ``refusals``: (run_id, rule, detail). ``records``: one row per test image with its fold, threshold and all metrics.
    ``filled``: the stored metric rows with the columns of ``FILLED`` set. ``folds``: threshold, thin edge and skeleton
    pixels per fold. ``reliability``: bins over all test images of a run. ``summary``: one nested row per run.
    """

    refusals: DataFrame
    records: DataFrame
    filled: DataFrame
    folds: DataFrame
    reliability: DataFrame
    summary: DataFrame


def with_thresholds(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Every scored pixel with the threshold its fold chose; a fold that holds most pixels is many keys."""
    chosen = thresholds.select("run_id", "fold", "threshold")
    return salted_lookup(scored, chosen, ["run_id", "fold"], ["dataset", "image_id", "row", "col"])


def code_refusals(runs: DataFrame, commit: str, dirty: bool) -> DataFrame:
    """Q19: runs from a clean tree that the evaluating checkout is not; a run from a dirty tree may be evaluated by any."""
    same = F.lit(not dirty) & (F.col("git_commit") == commit)
    now = commit + (" with uncommitted changes" if dirty else "")
    return runs.where(~F.coalesce(F.col("git_dirty"), F.lit(False)) & ~F.coalesce(same, F.lit(False))).select(
        "run_id", F.lit("other code").alias("rule"),
        F.concat(F.lit("trained at "), F.coalesce("git_commit", F.lit("missing")), F.lit(f", evaluated at {now}")).alias("detail"),
    )


def _counted(rows: DataFrame, rule: str, what: str) -> DataFrame:
    """One refusal per run, with the number of its rows."""
    return rows.groupBy("run_id").agg(F.count("*").alias("_n")).select(
        "run_id", F.lit(rule).alias("rule"), F.concat(F.col("_n").cast("string"), F.lit(f" {what}")).alias("detail")
    )


def tuning_edges(assignments: DataFrame, radii: DataFrame, quantile: float) -> DataFrame:
    """The thin edge of each run's fold, over the skeletons of its training and validation images.

    Skeletons are counted per image and squared distance once, whatever the number of runs and folds that use the image.
    """
    counts = radii.groupBy("dataset", "image_id", "d2").agg(F.count("*").alias("_n"))
    tuning = assignments.where("role IN ('train', 'val')").select("run_id", "fold", "dataset", "image_id").distinct()
    pooled = tuning.join(counts, ["dataset", "image_id"]).groupBy("run_id", "fold", "d2").agg(F.sum("_n").alias("_n"))
    return spatial.thin_edge_of_counts(pooled, ["run_id", "fold"], quantile)


def evaluate_runs(
    t: Tables, scored: DataFrame, truth: DataFrame, *, commit: str, dirty: bool, data_hash: str, bins: int, quantile: float
) -> Evaluation:
    """Evaluate the held-out scores of every run in ``t["runs"]``.

    ``t`` holds runs, fold_status (latest rows), thresholds, fold_assignments and per_image_metrics; ``scored`` the pixels
    of test images (run_id, dataset, image_id, fold, row, col, prob, label, in_fov), ``truth`` those of all images
    (dataset, image_id, row, col, label, in_fov). ``commit`` and ``dirty`` describe the evaluating checkout, ``data_hash`` the
    verified data.

    A run is refused as a whole, and named with the reason, if it is not finished, trained with other code or data, has
    a score that is missing or outside [0, 1], a tested fold without a threshold, or a test image whose stored metrics are
    not exactly those of its scores at its fold's threshold. A missing value refuses. Runs jobs for the skeletons.
    """
    runs, stored = t["runs"], t["per_image_metrics"].where("prediction_mode = 'single'")
    tested = t["fold_assignments"].where("role = 'test'").select(*IMAGE, "fold").distinct()
    # A score that is no score refuses its run below; here it must not stop the others.
    sound = scored.where(F.col("prob").cast("double").between(0.0, 1.0) & F.col("label").isNotNull() & F.col("in_fov").isNotNull())
    judged = with_thresholds(sound, t["thresholds"])
    items = metrics.evaluate_items(judged, [*IMAGE, "fold", "threshold"], F.col("threshold"))
    open_folds = audit.expected_folds(runs).join(audit.complete_folds(t["fold_status"]), ["run_id", "fold"], "left_anti")
    unfinished = runs.where("finished_at IS NULL").select("run_id", F.lit(None).cast("int").alias("fold")).unionByName(open_folds)
    bad = metrics.score_validity(scored, [*IMAGE, "fold"]).where("n_bad > 0 OR NOT is_full")
    unscored = tested.join(scored.select(*IMAGE, "fold").distinct(), [*IMAGE, "fold"], "left_anti")
    # Rows of images that no fold tests are refused as well: the comparison finds them stored but not recomputed.
    differing = reconcile.compare_rows(stored, items.join(tested, [*IMAGE, "fold"], "left_semi"), IMAGE, STORED)
    parts = [
        _counted(unfinished, "not finished", "reasons"),
        code_refusals(runs, commit, dirty),
        runs.where(~F.coalesce(F.col("data_hash") == data_hash, F.lit(False))).select(
            "run_id", F.lit("other data").alias("rule"), F.coalesce("data_hash", F.lit("missing")).alias("detail")
        ),
        _counted(bad.unionByName(unscored, allowMissingColumns=True), "scores", "images"),
        _counted(tested.select("run_id", "fold").distinct().join(t["thresholds"], ["run_id", "fold"], "left_anti"), "no threshold", "folds"),
        _counted(differing, "not reproduced", "images"),
    ]
    refusals = parts[0]
    for part in parts[1:]:
        refusals = refusals.unionByName(part)
    refusals = refusals.join(runs.select("run_id"), "run_id", "left_semi")
    accepted = runs.select("run_id").join(refusals.select("run_id").distinct(), "run_id", "left_anti")

    radii = spatial.skeleton_radius(truth, ["dataset", "image_id"])
    edges = tuning_edges(t["fold_assignments"], radii, quantile)
    key = ["dataset", "image_id", "row", "col"]
    hits = judged.select(*IMAGE, "fold", "row", "col", S.is_positive(F.col("prob"), F.col("threshold")).alias("predicted")).join(
        radii.select(*key, "d2").hint("merge"), key
    )
    widths = spatial.width_sensitivity(hits, edges, [*IMAGE, "fold"], ["run_id", "fold"])
    records = spatial.with_items_without_skeleton(widths, items, [*IMAGE, "fold"]).join(accepted, "run_id", "left_semi")
    filled = reconcile.fill_evaluation(stored, records, IMAGE, FILLED).join(accepted, "run_id", "left_semi")
    totals = spatial.fold_width_totals(records, ["run_id", "fold"])
    folds = (
        totals.join(t["thresholds"].select("run_id", "fold", "threshold"), ["run_id", "fold"])
        .join(edges.select("run_id", "fold", "thin_edge"), ["run_id", "fold"], "left")
        .select("run_id", "fold", "threshold", "thin_edge", "n_thin", "n_thick")
    )
    calibration = metrics.reliability(sound.join(accepted, "run_id", "left_semi"), ["run_id"], bins)
    return Evaluation(refusals, records, filled, folds, calibration, _summary(folds, calibration, commit, dirty))


def _summary(folds: DataFrame, calibration: DataFrame, commit: str, dirty: bool) -> DataFrame:
    """One row per run, with a list of its folds and one of its calibration bins: both are short by configuration."""

    def listed(df: DataFrame, order: str, name: str) -> DataFrame:
        rest = [c for c in df.columns if c not in ("run_id", order)]
        return df.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct(order, *rest))).alias(name))

    code = F.struct(F.lit(commit).alias("commit"), F.lit(dirty).alias("dirty")).alias("code")
    return listed(folds, "fold", "folds").join(listed(calibration, "bin", "reliability"), "run_id").select(
        "run_id", code, "folds", "reliability"
    )


def store_evaluation(evaluation: Evaluation, run_ids: Sequence[str], root: str, path: str) -> None:
    """Write the named runs' metrics into the registry and then their summary; one refusal and nothing is written."""
    from maskaudit.sources import tables

    if not run_ids:
        raise ValueError("no runs to evaluate")
    named = F.col("run_id").isin(list(run_ids))
    problems = evaluation.refusals.where(named).orderBy("run_id", "rule").limit(20).collect()
    if problems:
        raise ValueError("; ".join(f"{r['run_id']}: {r['rule']} ({r['detail']})" for r in problems))
    known = evaluation.summary.where(named).select("run_id").distinct().count()
    if known != len(set(run_ids)):
        raise ValueError(f"{len(set(run_ids)) - known} of the runs have nothing to evaluate")
    mode = F.lit("single").alias("prediction_mode")
    records = evaluation.records.where(named).select(*IMAGE, mode, *FILLED)
    tables.write_evaluation(records.select(*KEYS["per_image_metrics"], *FILLED), root, list(FILLED))
    tables.write_summary(evaluation.summary.where(named), path)
