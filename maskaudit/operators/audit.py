"""Audits over the run registry: leakage, coverage, lifecycle and reportability.

Each rule returns rows ``(run_id, rule, detail)`` for all runs at once; an empty result is a pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# The roles, in the order they are listed.
ROLES = ("test", "train", "val")
MARKS = 1 << 18  # assignments whose images one task reduces, more or less


def leakage_audit(assignments: DataFrame) -> DataFrame:
    """Images with several roles in a fold, or tested in several folds."""
    # One flag per role keeps this a plain hash aggregation; other roles break the role rule.
    held = [F.when(F.bool_or(F.col("role") == r), F.lit(r)) for r in ROLES]
    roles = (
        assignments.groupBy("run_id", "fold", "dataset", "image_id")
        .agg(F.array_compact(F.array(*held)).alias("_roles"))
        .where(F.size("_roles") > 1)
        .select(
            "run_id", "dataset", "image_id",
            F.concat(F.lit("more than one role in fold "), F.col("fold").cast("string")).alias("problem"),
            F.array_join("_roles", ",").alias("detail"),
        )
    )
    folds = (
        assignments.where("role = 'test'")
        .groupBy("run_id", "dataset", "image_id")
        .agg(F.collect_set("fold").alias("_folds"))
        .where(F.size("_folds") > 1)
        .select(
            "run_id", "dataset", "image_id",
            F.lit("test in more than one fold").alias("problem"),
            F.array_join(F.transform(F.array_sort("_folds"), lambda f: f.cast("string")), ",").alias("detail"),
        )
    )
    return roles.unionByName(folds)


def latest_status(events: DataFrame) -> DataFrame:
    """The row of each fold's last attempt; ties go to a completed row."""
    rank = F.struct("attempts", F.col("status") == "complete", "started_at", "checkpoint_sha256")
    row = F.struct("status", "checkpoint_sha256", "started_at", "completed_at", "attempts")
    return (
        events.groupBy("run_id", "fold")
        .agg(F.max_by(row, rank).alias("_s"))
        .select("run_id", "fold", "_s.*")
    )


def complete_folds(statuses: DataFrame) -> DataFrame:
    return statuses.where("status = 'complete'").select("run_id", "fold")


def rows_of_complete_folds(table: DataFrame, statuses: DataFrame) -> DataFrame:
    """What readers may see: rows of folds whose completion was recorded.

    Where rows carry the number of the ``attempt`` that wrote them, only those of the completed one are seen; a NULL
    attempt belongs to whichever completed.
    """
    if "attempt" not in table.columns:
        return table.join(complete_folds(statuses), ["run_id", "fold"], "left_semi")
    done = statuses.where("status = 'complete'").select(
        F.col("run_id").alias("_r"), F.col("fold").alias("_f"), F.col("attempts").alias("_a")
    )
    same = (F.col("run_id") == F.col("_r")) & (F.col("fold") == F.col("_f"))
    return table.join(done, same & (F.coalesce("attempt", "_a") == F.col("_a")), "left_semi")


def startable_folds(wanted: DataFrame, statuses: DataFrame) -> DataFrame:
    """Folds still to run, with the number of the attempt; complete folds are left out."""
    last = statuses.select("run_id", "fold", "status", F.col("attempts").alias("_a"))
    return (
        wanted.join(last, ["run_id", "fold"], "left")
        .where("status IS NULL OR status <> 'complete'")
        .select("run_id", "fold", (F.coalesce("_a", F.lit(0)) + 1).cast("int").alias("attempts"))
    )


def expected_folds(runs: DataFrame) -> DataFrame:
    """Folds 1..n of each run, n from its stored config."""
    n = F.get_json_object("config", "$.folds.n_folds").cast("int")
    return runs.select("run_id", F.explode(F.sequence(F.lit(1), n)).alias("fold"))


def incomplete_folds(runs: DataFrame, statuses: DataFrame) -> DataFrame:
    """Q11: configured folds without a completed attempt."""
    return expected_folds(runs).join(complete_folds(statuses), ["run_id", "fold"], "left_anti")


def finishable_runs(runs: DataFrame, statuses: DataFrame) -> DataFrame:
    """Q18: whether a run may finish: none of its started folds is open."""
    state = statuses.groupBy("run_id").agg(
        F.count("*").alias("n_started"), F.count_if(F.col("status") != "complete").alias("n_open")
    )
    return runs.select("run_id").join(state, "run_id", "left").select(
        "run_id",
        F.coalesce("n_started", F.lit(0)).alias("n_started"),
        F.coalesce("n_open", F.lit(0)).alias("n_open"),
        (F.coalesce("n_open", F.lit(0)) == 0).alias("can_finish"),
    )


RESUME_KEYS = ("variant", "config_hash", "git_commit", "data_hash")


def resumable_runs(runs: DataFrame) -> DataFrame:
    """Q17: unfinished clean runs per (variant, config, commit, data); several are ambiguous."""
    return (
        runs.where("finished_at IS NULL AND NOT git_dirty")
        .groupBy(*RESUME_KEYS)
        .agg(F.min("run_id").alias("run_id"), F.count("*").alias("n_runs"))
        .withColumn("ambiguous", F.col("n_runs") > 1)
    )


def latest_finished_run(runs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The last finished run; run ids sort by time."""
    return runs.where("finished_at IS NOT NULL").groupBy(*by).agg(F.max("run_id").alias("run_id"))


def duplicate_variants(runs: DataFrame) -> DataFrame:
    """Variants with more than one reported run, which a table could not tell apart."""
    return (
        runs.where("is_reported").groupBy("variant").agg(F.count("*").alias("n_runs")).where("n_runs > 1")
    )


def never_tested(images: DataFrame, assignments: DataFrame, run_ids: Sequence[str]) -> DataFrame:
    """Labelled images the named runs never tested; each named run owes a test of every labelled image."""
    if not run_ids:
        raise ValueError("no runs to check")
    named = F.array(*[F.lit(r) for r in run_ids])
    owed = images.where("has_labels").select(F.explode(named).alias("run_id"), "dataset", "image_id")
    tested = assignments.where("role = 'test'").select("run_id", "dataset", "image_id")
    return owed.join(tested, ["run_id", "dataset", "image_id"], "left_anti")


def never_tested_counts(images: DataFrame, assignments: DataFrame, runs: DataFrame) -> DataFrame:
    """How many labelled images each run never tested, without pairing runs with images.

    A run owes one test to every labelled image of the datasets it was assigned, and without any assignment to every
    labelled image there is.
    """
    labelled = images.where("has_labels").select("dataset", "image_id")
    needed = labelled.groupBy("dataset").agg(F.count("*").alias("_need"))
    tested = assignments.where("role = 'test'").select("run_id", "dataset", "image_id").distinct()
    covered = (
        tested.join(labelled, ["dataset", "image_id"], "left_semi")
        .groupBy("run_id", "dataset")
        .agg(F.count("*").alias("_have"))
    )
    known = assignments.select("run_id", "dataset").distinct()
    owing = (
        known.join(needed, "dataset")
        .join(covered, ["run_id", "dataset"], "left")
        .groupBy("run_id")
        .agg(F.sum(F.col("_need") - F.coalesce("_have", F.lit(0))).alias("n_missing"))
    )
    every = labelled.agg(F.count("*")).scalar()
    idle = runs.select("run_id").join(known, "run_id", "left_anti").select("run_id", every.alias("n_missing"))
    return owing.unionByName(idle).where("n_missing > 0")


def untested_rows(metrics: DataFrame, assignments: DataFrame) -> DataFrame:
    """Metric rows for images the run never tested."""
    tested = assignments.where("role = 'test'").select("run_id", "dataset", "image_id")
    return (
        metrics.where("prediction_mode = 'single'")
        .select("run_id", "dataset", "image_id")
        .join(tested, ["run_id", "dataset", "image_id"], "left_anti")
    )


def test_coverage(metrics: DataFrame, assignments: DataFrame) -> DataFrame:
    """Tested, evaluated and labelled-row counts per run, compared as sets of images."""
    key = ["run_id", "dataset", "image_id"]
    tested = assignments.where("role = 'test'").select(*key).distinct().withColumn("_t", F.lit(True))
    rows = metrics.where("prediction_mode = 'single'").groupBy(*key).agg(
        F.bool_or(F.col("brier").isNotNull()).alias("_done")
    )
    both = tested.join(rows, key, "full_outer")
    is_tested, done = F.col("_t").isNotNull(), F.coalesce(F.col("_done"), F.lit(False))
    return both.groupBy("run_id").agg(
        F.count_if(is_tested).alias("n_tested"),
        F.count_if(is_tested & done).alias("n_evaluated"),
        F.count_if(~is_tested).alias("n_untested_rows"),
    )


def _number(name: str) -> Column:
    return F.coalesce(name, F.lit(0))


def _fails(holds: Column) -> Column:
    """A rule is kept only where it surely holds: a missing value or key breaks it."""
    return ~F.coalesce(holds, F.lit(False))


def _shown(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("missing"))


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _listed(state: DataFrame, rules: Mapping[str, tuple[Column, Column]], checkpoints: Column | None = None) -> DataFrame:
    """One row per rule that a run breaks, from one row per run."""

    def entry(name: str, detail: Column) -> Column:
        return F.struct(F.lit(name).alias("rule"), detail.alias("detail"))

    broken = F.array_compact(F.array(*[F.when(cond, entry(name, detail)) for name, (cond, detail) in rules.items()]))
    if checkpoints is not None:
        broken = F.concat(broken, F.transform(checkpoints, lambda x: entry("checkpoint", x)))
    return state.select("run_id", F.explode(broken).alias("_b")).select("run_id", "_b.rule", "_b.detail")


def own_rules(gpu_type: str, platform: str) -> dict[str, tuple[Column, Column]]:
    """The rules that need only a run's own row and ``n_complete``, the number of its complete folds."""
    n = F.get_json_object("config", "$.folds.n_folds").cast("int")
    asked = F.get_json_object("config", "$.training.deterministic_ops")
    return {
        "unfinished": (
            _fails(F.col("finished_at").isNotNull() & (_number("n_complete") == n)),
            _text(_number("n_complete"), " of ", _shown(n), " folds complete"),
        ),
        "dirty tree": (_fails(~F.col("git_dirty")), F.lit("")),
        "no tag": (F.col("git_tag").isNull(), F.lit("")),
        "hardware": (
            _fails((F.col("gpu_type") == gpu_type) & (F.col("compute_platform") == platform)),
            _text(_shown(F.col("gpu_type")), " on ", _shown(F.col("compute_platform"))),
        ),
        "determinism": (
            _fails(F.col("deterministic_ops").cast("string") == asked),
            _text("recorded ", _shown(F.col("deterministic_ops")), ", asked ", _shown(asked)),
        ),
    }


def run_rules(runs: DataFrame, statuses: DataFrame, gpu_type: str, platform: str) -> DataFrame:
    """The rules that need only a run's own row and its fold statuses."""
    done = complete_folds(statuses).groupBy("run_id").agg(F.count("*").alias("n_complete"))
    return _listed(runs.join(done, "run_id", "left"), own_rules(gpu_type, platform))


def image_state(assignments: DataFrame, metrics: DataFrame, images: DataFrame) -> DataFrame:
    """One row of counters per run over its images: what was assigned, tested, evaluated and leaked.

    Assignments and metric rows of a run's image meet in one exchange, by run and image, so a run that holds most rows
    spreads over its images. Their counters go on to the run with map-side sums.

    Rows of one run differ little and shuffle to few bytes, by which Spark would give a task far more of them than it can
    hold. So the assignments are counted first, and the exchange has as many partitions as their number needs.
    """
    key = ["run_id", "dataset", "image_id"]
    none = F.lit(None)
    marks = assignments.select(*key, "fold", "role", none.cast("boolean").alias("_done")).unionByName(
        metrics.where("prediction_mode = 'single'").select(
            *key, none.cast("int").alias("fold"), none.cast("string").alias("role"), F.col("brier").isNotNull().alias("_done")
        )
    )
    held = [F.coalesce(F.bool_or(F.col("role") == r), F.lit(False)).cast("int") for r in ROLES]
    partitions = int(assignments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(partitions, assignments.count() // MARKS + 1)
    per_fold = marks.repartition(partitions, *key).groupBy(*key, "fold").agg(
        (held[0] + held[1] + held[2]).alias("_roles"),
        held[ROLES.index("test")].alias("_test"),
        F.bool_or(F.col("role").isNotNull()).alias("_assigned"),
        F.bool_or("_done").alias("_done"),
    )
    tests = F.sum("_test")
    per_image = per_fold.groupBy(*key).agg(
        (F.count_if(F.col("_roles") > 1) + (tests > 1).cast("bigint")).alias("_leaks"),
        (tests > 0).alias("_tested"),
        F.bool_or("_assigned").alias("_assigned"),
        F.bool_or("_done").alias("_done"),
    )
    labelled = images.where("has_labels").select("dataset", "image_id", F.lit(True).alias("_labelled")).distinct()
    seen = per_image.join(labelled, ["dataset", "image_id"], "left")
    return seen.groupBy("run_id").agg(
        F.sum("_leaks").alias("n_leaks"),
        F.count_if("_tested").alias("n_tested"),
        F.count_if(F.col("_tested") & F.coalesce("_done", F.lit(False))).alias("n_evaluated"),
        F.count_if(~F.col("_tested") & F.col("_done").isNotNull()).alias("n_untested_rows"),
        F.count_if(F.col("_tested") & F.col("_labelled")).alias("n_labelled"),
        F.collect_set(F.when(F.col("_assigned"), F.col("dataset"))).alias("datasets"),
    )


def fold_state(statuses: DataFrame, artifacts: DataFrame) -> DataFrame:
    """One row per run over its complete folds: their number, and the problems of their checkpoints."""
    have = artifacts.select("run_id", "fold", F.col("digest").alias("_have"))
    joined = statuses.where("status = 'complete'").join(have, ["run_id", "fold"], "left")
    problem = _checkpoint_problem()
    shown = F.concat(F.lit("fold "), F.col("fold").cast("string"), F.lit(": "), problem)
    # A fold has one status; several artifacts of one fold are several problems, not several folds.
    return joined.groupBy("run_id").agg(
        F.size(F.collect_set("fold")).cast("bigint").alias("n_complete"),
        F.collect_list(F.when(problem.isNotNull(), shown)).alias("checkpoints"),
    )


def reportability(
    runs: DataFrame,
    statuses: DataFrame,
    assignments: DataFrame,
    metrics: DataFrame,
    images: DataFrame,
    evaluations: DataFrame,
    artifacts: DataFrame,
    data_hashes: DataFrame,
    *,
    gpu_type: str,
    platform: str,
) -> DataFrame:
    """Q14, Q19: every failed rule of every run as (run_id, rule, detail).

    ``evaluations`` holds (run_id, commit, dirty) of each run's evaluation, ``artifacts``
    (run_id, fold, digest) of the checkpoints found, ``data_hashes`` (dataset, data_hash) of the
    verified data, whose hash a run must have trained on: each dataset that a run was assigned has to be verified
    with the run's hash, and a run without assignments with some hash. A missing value breaks a rule.

    Every table is reduced to one row of counters and flags per run (``image_state``, ``fold_state``); these rows meet
    their run in joins on the run alone, and all rules are then conditions on one row.
    """
    labelled = images.where("has_labels").select("dataset", "image_id").distinct()
    needed = labelled.groupBy("dataset").agg(F.count("*").alias("n"))
    # One entry per dataset, a short list of the registry's own (``schemas`` names three).
    owed = needed.agg(F.map_from_entries(F.collect_list(F.struct("dataset", "n")))).scalar()
    verified = data_hashes.where("dataset IS NOT NULL").groupBy("data_hash").agg(F.collect_set("dataset").alias("_verified"))
    evaluated = evaluations.select("run_id", F.col("commit").alias("_c"), F.col("dirty").alias("_d"))
    state = (
        runs.join(image_state(assignments, metrics, images), "run_id", "left")
        .join(fold_state(statuses, artifacts), "run_id", "left")
        .join(evaluated, "run_id", "left")
        .join(verified, "data_hash", "left")
        .withColumn("_owed", owed)
    )

    used = F.size(F.coalesce("datasets", F.array().cast("array<string>"))) > 0
    # A run owes one test to every labelled image of its datasets, and without any to every labelled image there is.
    theirs = F.filter(F.map_entries("_owed"), lambda e: ~used | F.array_contains("datasets", e["key"]))
    n_owed = F.coalesce(F.aggregate(theirs, F.lit(0).cast("bigint"), lambda s, e: s + e["value"]), F.lit(0))
    n_missing = n_owed - _number("n_labelled")
    known = F.col("_verified").isNotNull() & (~used | (F.size(F.array_except("datasets", "_verified")) == 0))
    rules = own_rules(gpu_type, platform) | {
        "data hash": (_fails(known), _shown(F.col("data_hash"))),
        "never tested": (n_missing > 0, _text(n_missing, " labelled images")),
        "partly evaluated": (
            _number("n_evaluated") != _number("n_tested"), _text(_number("n_evaluated"), " of ", _number("n_tested")),
        ),
        "rows for untested": (_number("n_untested_rows") > 0, _text(_number("n_untested_rows"), " images")),
        "evaluation": (
            _fails((F.col("_c") == F.col("git_commit")) & ~F.col("_d")),
            F.when(F.col("_c").isNull(), "missing").otherwise(
                _text("by ", F.col("_c"), F.when(F.col("_d"), " (dirty)").when(F.col("_d").isNull(), " (unknown)").otherwise(""))
            ),
        ),
        "leakage": (_number("n_leaks") > 0, _text(_number("n_leaks"), " rows")),
    }

    return _listed(state, rules, F.coalesce("checkpoints", F.array().cast("array<string>")))


def _checkpoint_problem() -> Column:
    return F.when(F.col("_have").isNull(), "missing").when(
        ~F.col("_have").eqNullSafe(F.col("checkpoint_sha256")), "mismatch"
    )


def artifact_problems(statuses: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Q13: complete folds whose checkpoint is missing or has another digest."""
    have = artifacts.select("run_id", "fold", F.col("digest").alias("_have"))
    joined = statuses.where("status = 'complete'").join(have, ["run_id", "fold"], "left")
    return joined.select("run_id", "fold", _checkpoint_problem().alias("problem")).where("problem IS NOT NULL")


def mark_reportable(runs: DataFrame, problems: DataFrame) -> DataFrame:
    """Q16: runs without a single problem, as they would be stored once marked reported."""
    return runs.join(problems.select("run_id"), "run_id", "left_anti").withColumn(
        "is_reported", F.lit(True)
    )


def tabulation_refusals(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Why a run cannot be tabulated: unfinished, unevaluated, unreported, or a double variant."""
    state = metrics.where("prediction_mode = 'single'").groupBy("run_id").agg(
        F.count("*").alias("_n"), F.count_if(F.col("brier").isNull()).alias("_open")
    )
    double = duplicate_variants(runs).select("variant", F.lit(True).alias("_double"))
    checks = {
        "unfinished": F.col("finished_at").isNull(),
        "not evaluated": F.col("_n").isNull() | (F.col("_open") > 0),
        "not reported": ~F.col("is_reported"),
        "more than one run per variant": F.col("is_reported") & F.col("_double").isNotNull(),
    }
    broken = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in checks.items()]))
    return (
        runs.join(state, "run_id", "left")
        .join(double, "variant", "left")
        .select("run_id", F.explode(broken).alias("rule"))
    )


def env_changes(before: DataFrame, after: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Environment fields whose value differs between two manifests of a run."""

    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, *[F.col(f).cast("string").alias(f) for f in fields]).unpivot(
            [key], list(fields), "field", name
        )

    return (
        long(before, "was")
        .join(long(after, "now"), [key, "field"])
        .where(~F.col("was").eqNullSafe(F.col("now")))
    )


def early_stop_trace(history: DataFrame, patience: int) -> DataFrame:
    """E5: per epoch, whether validation dice improved and whether training stops there.

    Only a strictly higher dice improves. The windows hold one fold's epochs.
    """
    if patience < 1:
        raise ValueError(f"patience must be at least 1, got {patience}")
    fold = Window.partitionBy("run_id", "fold").orderBy("epoch")
    before = fold.rowsBetween(Window.unboundedPreceding, -1)
    upto = fold.rowsBetween(Window.unboundedPreceding, 0)
    best = F.max("val_dice").over(before)
    step = history.select(
        "run_id", "fold", "epoch", "val_dice",
        F.coalesce(F.col("val_dice") > F.coalesce(best, F.lit(-1.0)), F.lit(False)).alias("improved"),
        F.row_number().over(fold).alias("_i"),
    )
    last_best = F.last(F.when(F.col("improved"), F.col("_i")), ignorenulls=True).over(upto)
    counted = step.withColumn(
        "since_best", (F.col("_i") - F.coalesce(last_best, F.lit(0))).cast("bigint")
    )
    stops = (F.col("since_best") >= patience).cast("int")
    earlier = F.coalesce(F.max(stops).over(before), F.lit(0))
    return counted.select(
        "run_id", "fold", "epoch", "val_dice", "improved", "since_best",
        (stops == 1).alias("stop"),
        (earlier == 0).alias("trained"),
    )
