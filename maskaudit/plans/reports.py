"""Report tables as DataFrames, and the Markdown sink for the small ones."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskaudit import schemas
from maskaudit.functions import scalars as S
from maskaudit.operators import audit, quality, stats
from maskaudit.operators.ranking import running_counts
from maskaudit.plans.queries import held_out, threshold_log

Tables = Mapping[str, DataFrame]

HEADLINE = (
    "dice", "sensitivity", "specificity", "precision_score", "accuracy", "auc_roc", "auc_pr", "brier",
)
WIDTHS = ("thin_sensitivity", "thick_sensitivity")
PATHOLOGY = ("dice", "sensitivity", "auc_pr")
# The bootstrap settings of the report.
RESAMPLES = 10_000
SEED = 20260927
LEVEL = 0.95


def _long(rows: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    return stats.long_metrics(rows, ["run_id"], "image_id", metrics)


def headline(
    t: Tables, dataset: str, resamples: int = RESAMPLES, seed: int = SEED, level: float = LEVEL
) -> DataFrame:
    """Spread and interval of every metric per run, plus the majority-class accuracy."""
    rows = held_out(t["per_image_metrics"], dataset).select("run_id", "dataset", "image_id", *HEADLINE)
    # One exchange of all columns for both passes, which neither narrows: the metrics are worked out once.
    rows = rows.repartition(*rows.columns)
    values = _long(rows, HEADLINE)
    summary = stats.summary_with_ci(values, ["run_id", "metric"], "image_id", resamples, seed, level)
    fraction = t["images"].select("dataset", "image_id", "vessel_fraction_in_fov")
    labelled = rows.select("run_id", "dataset", "image_id").join(fraction, ["dataset", "image_id"])
    majority = stats.majority_accuracy(labelled, ["run_id"], "vessel_fraction_in_fov")
    return summary.join(majority, "run_id")


def width_summary(
    t: Tables, dataset: str, resamples: int = RESAMPLES, seed: int = SEED, level: float = LEVEL
) -> DataFrame:
    """Recall on thin and thick skeleton pixels across images."""
    return stats.summary_with_ci(
        _long(held_out(t["per_image_metrics"], dataset), WIDTHS), ["run_id", "metric"], "image_id", resamples, seed, level
    )


def per_image(t: Tables, dataset: str) -> DataFrame:
    """R2: every held-out image with its fold, flag and metrics."""
    flags = t["images"].select("dataset", "image_id", "has_abnormality")
    columns = [c for c in HEADLINE if c != "accuracy"] + list(WIDTHS)
    return (
        held_out(t["per_image_metrics"], dataset)
        .join(flags, ["dataset", "image_id"])
        .select("run_id", "image_id", "fold", "has_abnormality", *columns)
    )


def per_fold(t: Tables, dataset: str, edges: DataFrame) -> DataFrame:
    """Each fold's test images, threshold, epochs, edge and skeleton pixels.

    ``edges`` holds (run_id, fold, thin_edge, n_thin, n_thick). The test images themselves are
    ``fold_test_images``, one row each: a fold's list has no bound.
    """
    tests = (
        held_out(t["per_image_metrics"], dataset)
        .groupBy("run_id", "fold")
        .agg(
            F.count("*").alias("n_test"),
            F.min("image_id").alias("first_test"),
            F.max("image_id").alias("last_test"),
        )
    )
    return (
        threshold_log(t)
        .drop("is_reported", "is_finished", "variant")
        .join(tests, ["run_id", "fold"], "left")
        .join(edges, ["run_id", "fold"], "left")
    )


def fold_test_images(t: Tables, dataset: str) -> DataFrame:
    """The test images of every fold."""
    return held_out(t["per_image_metrics"], dataset).select("run_id", "fold", "image_id")


def fold_edge_reconcile(edges: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Folds whose evaluation summary and stored threshold disagree, or that one side lacks."""
    left = edges.select("run_id", "fold", F.col("threshold").alias("_e"), F.lit(True).alias("_l"))
    right = thresholds.select("run_id", "fold", F.col("threshold").alias("_t"), F.lit(True).alias("_r"))
    problem = (
        F.when(F.col("_r").isNull(), "not in the registry")
        .when(F.col("_l").isNull(), "not in the summary")
        .when(~F.col("_e").eqNullSafe(F.col("_t")), "thresholds differ")
    )
    return (
        left.join(right, ["run_id", "fold"], "full_outer")
        .select("run_id", "fold", problem.alias("problem"))
        .where("problem IS NOT NULL")
    )


def edge_consistency(edges: DataFrame, decimals: int = 3) -> DataFrame:
    """The distinct edges of a run's folds, as text; one means all folds agree."""
    text = F.format_string(f"%.{decimals}f", "thin_edge")
    return edges.groupBy("run_id").agg(
        F.array_join(F.array_sort(F.collect_set(text)), ", ").alias("edges"),
        F.count_distinct(text).alias("n_edges"),
    )


def subgroup(t: Tables, dataset: str) -> DataFrame:
    """Abnormal images against the rest."""
    flags = t["images"].select("dataset", "image_id", "has_abnormality")
    rows = held_out(t["per_image_metrics"], dataset).join(flags, ["dataset", "image_id"])
    values = stats.long_metrics(rows, ["run_id", "has_abnormality"], "image_id", PATHOLOGY)
    return stats.subgroup_summary(values, ["run_id", "metric"], "has_abnormality")


PROVENANCE = (
    "variant", "git_tag", "git_commit", "trained_clean", "evaluated_commit", "evaluated_clean",
    "data_hash", "leak_rows", "gpu_type", "compute_platform", "python_version",
    "tensorflow_version", "cuda_version", "deterministic_ops", "started_at", "finished_at", "minutes",
)


def _yes(flag: Column) -> Column:
    return F.when(flag, "yes").otherwise("no")


def provenance(t: Tables, evaluations: DataFrame) -> DataFrame:
    """One (field, value) row per fact about each finished run."""
    leaks = audit.leakage_audit(t["fold_assignments"]).groupBy("run_id").agg(F.count("*").alias("_l"))
    wide = (
        t["runs"].where("finished_at IS NOT NULL")
        .join(evaluations.select("run_id", "commit", "dirty"), "run_id", "left")
        .join(leaks, "run_id", "left")
        .withColumns(
            {
                "trained_clean": _yes(~F.col("git_dirty")),
                "evaluated_commit": F.col("commit"),
                "evaluated_clean": F.when(F.col("dirty").isNotNull(), _yes(~F.col("dirty"))),
                "leak_rows": F.coalesce("_l", F.lit(0)).cast("string"),
                "deterministic_ops": _yes(F.col("deterministic_ops")),
                "minutes": S.minutes_between(F.col("started_at"), F.col("finished_at")).cast("string"),
            }
        )
        .select("run_id", *PROVENANCE)
    )
    return wide.unpivot(["run_id"], list(PROVENANCE), "field", "value")


def chart_reliability(bins: DataFrame) -> DataFrame:
    """The points of the reliability diagram with their bin centres; empty bins have no point."""
    centre = (F.col("edge_low") + F.col("edge_high")) / F.lit(2.0)
    return bins.select(
        *[c for c in ("run_id",) if c in bins.columns],
        "bin", centre.alias("center"), "mean_probability", "vessel_fraction", "n_pixels",
    ).where("n_pixels > 0")


def chart_strip(t: Tables, dataset: str, spread: float = 0.15) -> DataFrame:
    """Per-image points of the width chart, spread evenly in image order."""
    flags = t["images"].select("dataset", "image_id", "has_abnormality")
    rows = held_out(t["per_image_metrics"], dataset).join(flags, ["dataset", "image_id"])
    values = stats.long_metrics(rows, ["run_id", "has_abnormality"], "image_id", WIDTHS)
    placed = running_counts(values, ["run_id", "metric"], [F.col("image_id")])
    steps = F.greatest(F.col("n_total") - 1, F.lit(1)).cast("double")
    offset = F.lit(-spread) + F.lit(2 * spread) * F.col("n_before").cast("double") / steps
    return placed.select("run_id", "metric", "image_id", "has_abnormality", "value", offset.alias("offset"))


def marked_history(t: Tables) -> DataFrame:
    """Training history with the chosen epoch of each fold marked."""
    best = threshold_log(t).select("run_id", "fold", "best_epoch")
    return (
        t["training_history"].join(best, ["run_id", "fold"], "left")
        .select(
            "run_id", "fold", "epoch", "train_loss", "val_dice",
            F.coalesce(F.col("epoch") == F.col("best_epoch"), F.lit(False)).alias("is_best"),
        )
    )


def median_image(metrics: DataFrame) -> DataFrame:
    """the image in the (lower) middle by (dice, id) of each run."""
    ranked = running_counts(metrics, ["run_id"], [F.asc("dice"), F.asc("image_id")])
    middle = F.floor((F.col("n_total") - 1) / F.lit(2))
    return ranked.where(F.col("n_before") == middle).select("run_id", "image_id", "dice")


def best_and_worst(metrics: DataFrame, n: int) -> DataFrame:
    """the n highest and n lowest images by dice of each run, ties by id.

    A run with fewer than 2n images stops the job, as its lists would share one. Both ranks are
    filtered to n, so Spark keeps n rows per run and task before the shuffle.
    """
    if n < 1:
        raise ValueError(f"n must be positive, got {n}")
    run = Window.partitionBy("run_id")
    rows = metrics.select("run_id", "image_id", "dice")

    def top(side: str, *order: Column) -> DataFrame:
        return (
            rows.withColumn("place", F.row_number().over(run.orderBy(*order)))
            .where(F.col("place") <= n)
            .select("run_id", F.lit(side).alias("side"), "place", "image_id", "dice")
        )

    few = F.concat("run_id", F.lit(f" has fewer than {2 * n} images"))
    enough = (
        rows.groupBy("run_id").agg(F.count("*").alias("_n"))
        .where(F.when(F.col("_n") >= 2 * n, F.lit(True)).otherwise(F.raise_error(few).cast("boolean")))
    )
    both = top("best", F.desc("dice"), F.asc("image_id")).unionByName(
        top("worst", F.asc("dice"), F.asc("image_id"))
    )
    return both.join(enough, "run_id", "left_semi")


def lineage(t: Tables, dataset: str) -> DataFrame:
    """What a report of a run rests on: run, tag, commit, data hash and its images."""
    used = held_out(t["per_image_metrics"], dataset).select("run_id", "image_id")
    facts = t["runs"].select("run_id", "variant", "git_tag", "git_commit", "data_hash")
    return used.join(facts, "run_id")


def snapshot(t: Tables) -> dict[str, DataFrame]:
    """Every table as a release snapshot holds it: rows of reported runs only."""
    reported = t["runs"].where("is_reported").select("run_id")
    out = {}
    for name, df in t.items():
        if name in schemas.SNAPSHOT_WHOLE:
            out[name] = df
        elif "run_id" in df.columns:
            out[name] = df.join(reported, "run_id", "left_semi")
        else:
            raise ValueError(f"the snapshot has no rule for table {name}")
    return out


def dangling_references(t: Tables) -> DataFrame:
    """Q15 over all declared references among the given tables: (reference, key) rows."""
    parts = []
    for child, child_keys, parent, parent_keys in schemas.REFERENCES:
        if child not in t or parent not in t:
            continue
        lost = quality.dangling(t[child], t[parent], child_keys, parent_keys)
        parts.append(
            lost.select(
                F.lit(f"{child}({','.join(child_keys)})").alias("reference"),
                F.concat_ws("/", *[F.col(k).cast("string") for k in child_keys]).alias("key"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


#: The report tables of a run and the columns their rows are ordered by.
RUN_TABLES: dict[str, list[str]] = {
    "headline": ["metric"], "per_image": ["image_id"], "per_fold": ["fold"], "thin_thick": ["metric"], "calibration": ["bin"],
    "pathology": ["metric", "has_abnormality"], "provenance": ["field"],
}


def run_tables(t: Tables, dataset: str, edges: DataFrame, reliability: DataFrame, evaluations: DataFrame) -> dict[str, DataFrame]:
    """Every report table, one row set for all runs.

    ``edges`` (run_id, fold, thin_edge, n_thin, n_thick) and ``reliability`` (run_id and its bins) come from an evaluation,
    ``evaluations`` (run_id, commit, dirty) says which checkout made it.
    """
    return {
        "headline": headline(t, dataset),
        "per_image": per_image(t, dataset),
        "per_fold": per_fold(t, dataset, edges),
        "thin_thick": width_summary(t, dataset),
        "calibration": reliability,
        "pathology": subgroup(t, dataset),
        "provenance": provenance(t, evaluations),
    }


def write_run_tables(t: Tables, tables: Mapping[str, DataFrame], run_id: str, out: str, footer: str = "") -> None:
    """Write a run's report tables as Markdown, one folder each.

    A run that may not be tabulated is an error, and so is a metric with fewer than two images.
    """
    refusals = audit.tabulation_refusals(t["runs"], t["per_image_metrics"]).where(F.col("run_id") == run_id)
    reasons = sorted(r["rule"] for r in refusals.collect())
    if reasons:
        raise ValueError(f"run {run_id} cannot be tabulated: {', '.join(reasons)}")
    if t["runs"].where(F.col("run_id") == run_id).isEmpty():
        raise ValueError(f"no run {run_id}")
    few = stats.too_few(tables["headline"].where(F.col("run_id") == run_id)).collect()
    if few:
        raise ValueError(f"too few images for a spread of {', '.join(sorted(r['metric'] for r in few))}")
    for name, order in RUN_TABLES.items():
        rows = tables[name].where(F.col("run_id") == run_id).drop("run_id")
        write_markdown(rows, rows.columns, order, f"{out}/{run_id}/{name}", footer)


def markdown_lines(report: DataFrame, columns: list[str], decimals: int = 3) -> DataFrame:
    """The rows of a report as Markdown table lines, NULL as NA."""
    kinds = dict(report.dtypes)
    cells = [
        S.format_na(F.col(c), decimals) if kinds[c] == "double"
        else F.coalesce(F.col(c).cast("string"), F.lit("NA"))
        for c in columns
    ]
    return report.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def write_markdown(report: DataFrame, columns: list[str], order: list[str], path: str, footer: str = "") -> None:
    """Write a report of a few rows as one Markdown text file per report folder.

    The header, the rows in order and the lineage footer are one sorted DataFrame; nothing is
    collected. An existing folder is never replaced.
    """
    spark = report.sparkSession
    head = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    body = markdown_lines(report.orderBy(*order), columns)
    top = spark.createDataFrame([(line,) for line in head], "value string")
    parts = top.coalesce(1).union(body)
    if footer:
        parts = parts.union(spark.createDataFrame([("",), (footer,)], "value string").coalesce(1))
    parts.write.mode("errorifexists").text(path)
