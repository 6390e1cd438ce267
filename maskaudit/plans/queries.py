"""The five stored queries as DataFrame plans, and a registry to run them by name."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskaudit.operators.audit import leakage_audit
from maskaudit.operators.folds import fold_signatures
from maskaudit.operators.ranking import with_rank

Tables = Mapping[str, DataFrame]

# Report columns and the metric columns they average.
FOLD_MEANS = {
    "mean_dice": "dice",
    "mean_sensitivity": "sensitivity",
    "mean_specificity": "specificity",
    "mean_precision": "precision_score",
    "mean_accuracy": "accuracy",
    "mean_auc_roc": "auc_roc",
    "mean_auc_pr": "auc_pr",
    "mean_brier": "brier",
    "mean_thin_sensitivity": "thin_sensitivity",
    "mean_thick_sensitivity": "thick_sensitivity",
}
DELTAS = {
    "delta_dice": "dice",
    "delta_sensitivity": "sensitivity",
    "delta_specificity": "specificity",
    "delta_precision": "precision_score",
    "delta_auc_pr": "auc_pr",
    "delta_thin_sensitivity": "thin_sensitivity",
    "delta_thick_sensitivity": "thick_sensitivity",
}


def held_out(metrics: DataFrame, dataset: str) -> DataFrame:
    """Single-pass rows of one dataset's held-out images; all three filters reach the scan."""
    return metrics.where(
        (F.col("dataset") == dataset) & (F.col("prediction_mode") == "single") & F.col("fold").isNotNull()
    )


def finished(runs: DataFrame) -> DataFrame:
    return runs.where("finished_at IS NOT NULL")


def fold_summary(t: Tables, dataset: str) -> DataFrame:
    """How each finished run scores, fold by fold."""
    runs = finished(t["runs"]).select("run_id", "variant", "is_reported")
    return (
        held_out(t["per_image_metrics"], dataset)
        .groupBy("run_id", "fold")
        .agg(
            F.count("*").alias("n_images"),
            F.count("brier").alias("n_evaluated"),
            *[F.avg(m).alias(name) for name, m in FOLD_MEANS.items()],
        )
        .join(runs, "run_id")
        .select("run_id", "variant", "is_reported", "fold", "n_images", "n_evaluated", *FOLD_MEANS)
        .orderBy("variant", "run_id", "fold")
    )


def worst_images(t: Tables, dataset: str) -> DataFrame:
    """Held-out images of finished runs ranked by dice, lowest (and missing) first."""
    runs = finished(t["runs"]).select("run_id", "variant", "is_reported")
    images = t["images"].select("dataset", "image_id", "has_abnormality")
    rows = (
        held_out(t["per_image_metrics"], dataset)
        .join(runs, "run_id")
        .join(images, ["dataset", "image_id"])
        .select(
            "run_id", "variant", "is_reported", "image_id", "fold", "has_abnormality", "dice",
            "sensitivity", "precision_score", "thin_sensitivity", "thick_sensitivity",
        )
    )
    order = [F.asc_nulls_first("dice"), F.asc("image_id")]
    return with_rank(rows, ["run_id"], order, "dice_rank")


TILE = 256  # runs of one side that meet in one task


def _paired(t: Tables) -> DataFrame:
    """``paired_runs`` with ``_tile``, the tile of the other run.

    Runs that share a signature may be most runs. Each side of a signature is cut into tiles of about ``TILE`` runs by a
    hash, and only pairs of tiles meet in one task.
    """
    runs = finished(t["runs"]).join(fold_signatures(t["fold_assignments"]), "run_id", "left")
    shared = ["data_hash", "sig_rows", "sig_a", "sig_b"]
    is_base = F.col("variant") == "baseline"
    # A run without any assignment has the empty set, which equals another empty set.
    filled = runs.select(
        "run_id", "variant", "is_reported", "data_hash",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in shared[1:]],
    )
    sides = filled.groupBy(*shared).agg(F.count_if(is_base).alias("_b"), F.count_if(~is_base).alias("_o")).where("_b > 0 AND _o > 0")
    tiles = sides.select(*shared, *[F.ceil(F.col(c) / F.lit(TILE)).cast("int").alias(c) for c in ("_b", "_o")])
    tiled = filled.join(tiles, shared).withColumn("_h", F.pmod(F.xxhash64("run_id"), F.lit(1 << 30)).cast("int"))

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    base = tiled.where(is_base).select(
        *shared,
        F.col("run_id").alias("baseline_run_id"),
        F.col("is_reported").alias("baseline_is_reported"),
        (F.col("_h") % F.col("_b")).alias("_base_tile"),
        every("_o").alias("_tile"),
    )
    other = tiled.where(~is_base).select(
        *shared,
        F.col("run_id").alias("other_run_id"),
        F.col("variant").alias("other_variant"),
        F.col("is_reported").alias("other_is_reported"),
        every("_b").alias("_base_tile"),
        (F.col("_h") % F.col("_o")).alias("_tile"),
    )
    return base.join(other, [*shared, "_base_tile", "_tile"]).drop(*shared, "_base_tile")


def paired_runs(t: Tables) -> DataFrame:
    """C4: finished baseline and other runs with the same data and identical fold assignments."""
    return _paired(t).drop("_tile")


def variant_comparison(t: Tables, dataset: str) -> DataFrame:
    """Per image, each other variant's metrics minus the baseline's.

    A baseline's rows are copied once per tile of other runs that it is paired with, so even one baseline of all runs is
    many keys; an other run's rows meet by run and image.
    """
    rows = held_out(t["per_image_metrics"], dataset)
    pairs = _paired(t)
    key = ["dataset", "image_id", "prediction_mode"]
    base = rows.select(
        F.col("run_id").alias("baseline_run_id"), *key, "fold",
        *[F.col(m).alias(f"_b_{m}") for m in DELTAS.values()],
    )
    other = rows.select(
        F.col("run_id").alias("other_run_id"), *key,
        *[F.col(m).alias(f"_o_{m}") for m in DELTAS.values()],
    )
    copies = base.join(pairs.select("baseline_run_id", "_tile").distinct(), "baseline_run_id")
    return (
        copies.join(pairs, ["baseline_run_id", "_tile"])
        .join(other, ["other_run_id", *key])
        .select(
            "baseline_run_id", "other_run_id", "other_variant", "baseline_is_reported",
            "other_is_reported", "image_id", "fold",
            *[(F.col(f"_o_{m}") - F.col(f"_b_{m}")).alias(name) for name, m in DELTAS.items()],
        )
        .orderBy("other_variant", "baseline_run_id", "other_run_id", "image_id")
    )


def threshold_log(t: Tables) -> DataFrame:
    """Each fold's threshold, its first best epoch and the number of epochs trained."""
    h = t["training_history"].select("run_id", "fold", "epoch", F.col("val_dice").alias("_dice"))
    chosen = t["thresholds"].select("run_id", "fold", "threshold", "selection_rule", "val_dice")
    epochs = (
        chosen.select("run_id", "fold", "val_dice")
        .join(h, ["run_id", "fold"])
        .groupBy("run_id", "fold")
        .agg(
            F.min(F.when(F.col("_dice") == F.col("val_dice"), F.col("epoch"))).alias("best_epoch"),
            F.max("epoch").alias("n_epochs"),
        )
    )
    runs = t["runs"].select(
        "run_id", "variant", "is_reported", F.col("finished_at").isNotNull().alias("is_finished")
    )
    return (
        chosen.join(epochs, ["run_id", "fold"], "left")
        .join(runs, "run_id")
        .select(
            "run_id", "variant", "is_reported", "fold", "threshold", "selection_rule", "val_dice",
            "is_finished", "best_epoch", "n_epochs",
        )
        .orderBy("variant", "run_id", "fold")
    )


QUERIES: dict[str, Callable[[Tables, str], DataFrame]] = {
    "01_fold_summary": fold_summary,
    "02_worst_images": worst_images,
    "03_variant_comparison": variant_comparison,
    "04_leakage_audit": lambda t, dataset: leakage_audit(t["fold_assignments"]).orderBy(
        "run_id", "dataset", "image_id", "problem"
    ),
    "05_threshold_log": lambda t, dataset: threshold_log(t),
}


def run_query(t: Tables, name: str, dataset: str = "drive") -> DataFrame:
    """U4: run a stored query by name."""
    if name not in QUERIES:
        raise KeyError(f"no query {name!r}; known are {sorted(QUERIES)}")
    return QUERIES[name](t, dataset)
