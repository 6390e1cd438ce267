"""Table schemas, keys, references and rules of the run registry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskaudit.functions import scalars as S
from maskaudit.operators import quality as Q

SCHEMA_VERSION = 1

# The registry's tables and columns, as DDL.
TABLES: dict[str, str] = {
    "images": (
        "dataset string, image_id string, patient_id string, split string, has_abnormality boolean, "
        "abnormality_note string, fov_pixels bigint, fov_source string, "
        "vessel_fraction_in_fov double, has_labels boolean"
    ),
    "frozen_models": (
        "model_id string, run_id string, checkpoint_sha256 string, threshold double, "
        "n_epochs int, git_commit string, frozen_at string"
    ),
    "runs": (
        "run_id string, variant string, config string, config_hash string, seed bigint, "
        "git_commit string, git_dirty boolean, git_tag string, data_hash string, "
        "python_version string, tensorflow_version string, cuda_version string, device string, "
        "gpu_type string, compute_platform string, deterministic_ops boolean, "
        "frozen_model_id string, applied_threshold double, started_at string, "
        "finished_at string, is_reported boolean"
    ),
    "fold_assignments": "run_id string, fold int, dataset string, image_id string, role string",
    "fold_status": (
        "run_id string, fold int, status string, checkpoint_sha256 string, started_at string, "
        "completed_at string, attempts int"
    ),
    "thresholds": (
        "run_id string, fold int, threshold double, selection_rule string, val_dice double"
    ),
    "per_image_metrics": (
        "run_id string, dataset string, image_id string, fold int, prediction_mode string, "
        "dice double, sensitivity double, specificity double, precision_score double, "
        "accuracy double, auc_roc double, auc_pr double, brier double, thin_sensitivity double, "
        "thick_sensitivity double, predicted_vessel_fraction double, mean_uncertainty double, "
        "uncertainty_error_auc double"
    ),
    "risk_coverage": (
        "run_id string, dataset string, image_id string, fraction_referred double, "
        "dice_retained double"
    ),
    "training_history": "run_id string, fold int, epoch int, train_loss double, val_dice double",
    "scored_pixels": (
        "run_id string, dataset string, image_id string, fold int, row int, col int, "
        "prob float, label boolean, in_fov boolean"
    ),
}

# Primary keys.
KEYS: dict[str, list[str]] = {
    "images": ["dataset", "image_id"],
    "frozen_models": ["model_id"],
    "runs": ["run_id"],
    "fold_assignments": ["run_id", "fold", "image_id", "role"],
    "fold_status": ["run_id", "fold"],
    "thresholds": ["run_id", "fold"],
    "per_image_metrics": ["run_id", "dataset", "image_id", "prediction_mode"],
    "risk_coverage": ["run_id", "dataset", "image_id", "fraction_referred"],
    "training_history": ["run_id", "fold", "epoch"],
}

# Fixed values: (child table, child columns, parent table, parent columns).
REFERENCES: list[tuple[str, list[str], str, list[str]]] = [
    ("frozen_models", ["run_id"], "runs", ["run_id"]),
    ("runs", ["frozen_model_id"], "frozen_models", ["model_id"]),
    ("fold_assignments", ["run_id"], "runs", ["run_id"]),
    ("fold_assignments", ["dataset", "image_id"], "images", ["dataset", "image_id"]),
    ("fold_status", ["run_id"], "runs", ["run_id"]),
    ("thresholds", ["run_id"], "runs", ["run_id"]),
    ("per_image_metrics", ["run_id"], "runs", ["run_id"]),
    ("per_image_metrics", ["dataset", "image_id"], "images", ["dataset", "image_id"]),
    ("risk_coverage", ["run_id"], "runs", ["run_id"]),
    ("risk_coverage", ["dataset", "image_id"], "images", ["dataset", "image_id"]),
    ("training_history", ["run_id"], "runs", ["run_id"]),
]

# Columns that hold a value in every row, besides those of the primary key.
REQUIRED: dict[str, list[str]] = {
    "images": ["split", "has_abnormality", "fov_pixels", "fov_source", "has_labels"],
    "frozen_models": ["run_id", "checkpoint_sha256", "threshold", "n_epochs", "git_commit", "frozen_at"],
    "runs": [
        "variant", "config", "config_hash", "seed", "git_commit", "git_dirty", "data_hash", "python_version",
        "tensorflow_version", "device", "gpu_type", "compute_platform", "deterministic_ops", "started_at", "is_reported",
    ],
    "fold_assignments": ["dataset"],
    "fold_status": ["status", "started_at", "attempts"],
    "thresholds": ["threshold", "selection_rule"],
    "per_image_metrics": [],
    "risk_coverage": [],
    "training_history": ["train_loss"],
}

# Tables a snapshot copies whole; every other one is restricted to reported runs.
SNAPSHOT_WHOLE = ("images",)
PARTITIONS: dict[str, list[str]] = {
    "fold_assignments": ["run_id"],
    "per_image_metrics": ["run_id"],
    "training_history": ["run_id"],
    "scored_pixels": ["run_id", "fold"],
}

RATIO_COLUMNS = (
    "dice", "sensitivity", "specificity", "precision_score", "accuracy", "auc_roc", "auc_pr",
    "brier", "thin_sensitivity", "thick_sensitivity", "predicted_vessel_fraction",
    "uncertainty_error_auc",
)


def reported_rules() -> dict[str, Column]:
    """Q5: a reported run has a clean tree, a tag and an end."""
    free = ~F.col("is_reported")
    return {
        "reported_needs_clean_tree": free | ~F.col("git_dirty"),
        "reported_needs_tag": free | F.col("git_tag").isNotNull(),
        "reported_needs_finish": free | F.col("finished_at").isNotNull(),
    }


def rules(table: str) -> dict[str, Column]:
    """Return every row rule of a table, by name; only the NOT NULL rules of a column fail on NULL."""
    c = F.col
    note = c("abnormality_note")
    by_table = {
        "images": lambda: {
            **Q.enum_rules(
                {
                    "dataset": ("drive", "stare", "chase"),
                    "split": ("training", "test", "external"),
                    "fov_source": ("official", "generated"),
                }
            ),
            **Q.unit_rules(["vessel_fraction_in_fov"]),
            **Q.minimum_rules({"fov_pixels": 1}),
            "fraction_needs_labels": c("has_labels") | c("vessel_fraction_in_fov").isNull(),
            "abnormal_iff_note": c("has_abnormality") == (note.isNotNull() & (note != "")),
        },
        "frozen_models": lambda: {
            **Q.unit_rules(["threshold"]),
            **Q.minimum_rules({"n_epochs": 1}),
            "frozen_at_format": S.timestamp_ok(c("frozen_at")),
        },
        "runs": lambda: {
            **Q.unit_rules(["applied_threshold"]),
            **reported_rules(),
            "model_and_threshold_together": c("frozen_model_id").isNull() == c("applied_threshold").isNull(),
            "started_at_format": S.timestamp_ok(c("started_at")),
            "finished_at_format": S.timestamp_ok(c("finished_at")),
        },
        "fold_assignments": lambda: {
            **Q.enum_rules({"role": ("train", "val", "test")}),
            **Q.minimum_rules({"fold": 1}),
        },
        "fold_status": lambda: {
            **Q.enum_rules({"status": ("running", "complete")}),
            **Q.minimum_rules({"fold": 1, "attempts": 1}),
            "started_at_format": S.timestamp_ok(c("started_at")),
            "completed_at_format": S.timestamp_ok(c("completed_at")),
            "complete_needs_outputs": (c("status") == "running")
            | (c("checkpoint_sha256").isNotNull() & c("completed_at").isNotNull()),
        },
        "thresholds": lambda: {
            **Q.unit_rules(["threshold", "val_dice"]),
            **Q.minimum_rules({"fold": 1}),
        },
        "per_image_metrics": lambda: {
            **Q.enum_rules({"prediction_mode": ("single", "tta")}),
            **Q.unit_rules(RATIO_COLUMNS),
            **Q.minimum_rules({"fold": 1, "mean_uncertainty": 0}),
        },
        "risk_coverage": lambda: Q.unit_rules(["fraction_referred", "dice_retained"]),
        "training_history": lambda: {
            **Q.unit_rules(["val_dice"]),
            **Q.minimum_rules({"fold": 0, "epoch": 0}),
        },
    }
    return by_table[table]() | required_rules(table)


def required_rules(table: str) -> dict[str, Column]:
    """Return a rule per column of a table that may not be NULL."""
    return Q.not_null_rules([*KEYS[table], *REQUIRED[table]])
