"""How the given tables become domain tables, once in Spark and once as SQL text.

The two definitions of a table stand side by side. The SQL side is used only by the oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskaudit.functions import scalars as S
from maskaudit.operators import metrics, pixels
from maskaudit.session import spread

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
DATASET = "drive"
# run, variant, score scale, fold shift, finished, reported
RUNS = [
    ("alt", "dice_only", 0.8, 0, True, True),
    ("base", "baseline", 1.0, 0, True, True),
    ("open", "baseline", 1.0, 0, False, False),
    ("shift", "dice_only", 0.9, 1, True, False),
]
N_FOLDS = 5


def query(name: str, sql: str | None = None):
    """Register a query with the SQL that must give the same rows."""

    def add(fn):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = (fn, sql)
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, text: str, *needs: str) -> None:
    CTES[name] = (text, needs)


def sql(body: str, *needs: str) -> str:
    """Prefix a SELECT with the tables it needs."""
    order: list[str] = []

    def visit(name: str) -> None:
        for n in CTES[name][1]:
            visit(n)
        if name not in order:
            order.append(name)

    for n in needs:
        visit(n)
    head = ",\n".join(f"{n} AS ({CTES[n][0]})" for n in order)
    return f"WITH {head}\n{body}" if head else body


def draw_sql(seed: int, purpose: str, *keys: str) -> str:
    parts = ", ".join([f"'{seed}'", f"'{purpose}'", *[f"cast({k} AS varchar)" for k in keys]])
    return f"cast('0x' || substr(md5(concat_ws('|', {parts})), 1, 15) AS bigint)"


def unit_sql(seed: int, purpose: str, *keys: str) -> str:
    return f"(cast({draw_sql(seed, purpose, *keys)} AS double) / 1152921504606846976.0::double)"


def ratio_sql(num: str, den: str) -> str:
    return f"(cast({num} AS double) / nullif(cast({den} AS double), 0))"


def dice_sql(tp: str, fp: str, fn: str) -> str:
    return (
        f"(CASE WHEN 2*{tp}+{fp}+{fn} = 0 THEN 1.0::double "
        f"ELSE cast(2*{tp} AS double) / cast(2*{tp}+{fp}+{fn} AS double) END)"
    )


def grid_sql(p: str, n: int) -> str:
    k, d = f"floor({p} * {n}.0::double)", f"{n}.0::double"
    return (
        f"cast(CASE WHEN ({k} + 1) / {d} <= {p} THEN {k} + 1 "
        f"WHEN {k} / {d} > {p} THEN {k} - 1 ELSE {k} END AS bigint)"
    )


# ---------------------------------------------------------------- scored items from events


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """One run: a user's events are the pixels of one image."""
    e = table(spark, sf, "events")
    kind = F.col("event_type")
    return e.select(
        F.lit("base").alias("run_id"),
        F.lit(DATASET).alias("dataset"),
        F.col("user_id").cast("string").alias("image_id"),
        (F.col("user_id") % N_FOLDS + 1).cast("int").alias("fold"),
        F.floor(F.col("event_id") / F.lit(64)).cast("int").alias("row"),
        (F.col("event_id") % 64).cast("int").alias("col"),
        F.least(F.col("value") / F.lit(300.0), F.lit(1.0)).cast("float").alias("prob"),
        kind.isin("purchase", "signup").alias("label"),
        (kind != "error").alias("in_fov"),
    )


cte(
    "scored",
    """SELECT 'base' AS run_id, 'drive' AS dataset, cast(user_id AS varchar) AS image_id,
       cast(user_id % 5 + 1 AS integer) AS fold, cast(event_id // 64 AS integer) AS row,
       cast(event_id % 64 AS integer) AS col,
       cast(least(value / 300.0::double, 1.0::double) AS float) AS prob,
       event_type IN ('purchase', 'signup') AS label, event_type <> 'error' AS in_fov
FROM events""",
)


def scored_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The same items under four runs whose scores and folds differ."""
    runs = F.array(
        *[F.struct(F.lit(r[0]).alias("id"), F.lit(r[2]).alias("scale"), F.lit(r[3]).alias("shift")) for r in RUNS]
    )
    e = table(spark, sf, "events")
    kind = F.col("event_type")
    spread = e.select("*", F.explode(runs).alias("_r"))
    return spread.select(
        F.col("_r.id").alias("run_id"),
        F.lit(DATASET).alias("dataset"),
        F.col("user_id").cast("string").alias("image_id"),
        ((F.col("user_id") + F.col("_r.shift")) % N_FOLDS + 1).cast("int").alias("fold"),
        F.floor(F.col("event_id") / F.lit(64)).cast("int").alias("row"),
        (F.col("event_id") % 64).cast("int").alias("col"),
        (F.least(F.col("value") / F.lit(300.0), F.lit(1.0)) * F.col("_r.scale")).cast("float").alias("prob"),
        kind.isin("purchase", "signup").alias("label"),
        (kind != "error").alias("in_fov"),
    )


cte(
    "run_list",
    "SELECT * FROM (VALUES "
    + ", ".join(
        f"('{i}', '{v}', {s}::double, {k}, {str(f).lower()}, {str(r).lower()})" for i, v, s, k, f, r in RUNS
    )
    + ") AS v(run_id, variant, scale, shift, is_finished, is_reported)",
)
cte(
    "scored_runs",
    """SELECT r.run_id, 'drive' AS dataset, cast(user_id AS varchar) AS image_id,
       cast((user_id + r.shift) % 5 + 1 AS integer) AS fold,
       cast(event_id // 64 AS integer) AS row, cast(event_id % 64 AS integer) AS col,
       cast(least(value / 300.0::double, 1.0::double) * r.scale AS float) AS prob,
       event_type IN ('purchase', 'signup') AS label, event_type <> 'error' AS in_fov
FROM events, run_list r""",
    "run_list",
)

ITEM = ["run_id", "dataset", "image_id", "fold"]


def fold_threshold():
    """Threshold of a fold: 0.35, 0.40, ... by fold number."""
    return (F.col("fold") * 5 + 30).cast("double") / F.lit(100.0)


FOLD_THRESHOLD_SQL = "(cast(fold * 5 + 30 AS double) / 100.0::double)"


def eval_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The runs behind ``scored_runs``, with the time span of the events they scored."""
    rows = [(i, v, f, r) for i, v, _, _, f, r in RUNS]
    listed = spark.createDataFrame(rows, "run_id string, variant string, fin boolean, is_reported boolean")
    span = table(spark, sf, "events").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    stamp = S.TIMESTAMP_FORMAT
    first, last = span.select(F.date_format("a", stamp)).scalar(), span.select(F.date_format("b", stamp)).scalar()
    return listed.select(
        "run_id", "variant",
        F.lit('{"folds": {"n_folds": 5}, "training": {"deterministic_ops": true}}').alias("config"),
        F.lit("c0ffee").alias("git_commit"),
        (F.col("run_id") == "shift").alias("git_dirty"),
        F.when(F.col("is_reported"), "v0.1.0").alias("git_tag"),
        F.lit("data").alias("data_hash"),
        F.lit("Tesla T4").alias("gpu_type"), F.lit("colab").alias("compute_platform"),
        F.lit("3.13").alias("python_version"), F.lit("2.21").alias("tensorflow_version"),
        F.lit(None).cast("string").alias("cuda_version"),
        F.lit(True).alias("deterministic_ops"),
        first.alias("started_at"), F.when(F.col("fin"), last).alias("finished_at"), "is_reported",
    )


cte(
    "eval_runs",
    """SELECT run_id, variant, '{"folds": {"n_folds": 5}, "training": {"deterministic_ops": true}}' AS config,
       'c0ffee' AS git_commit, run_id = 'shift' AS git_dirty,
       CASE WHEN is_reported THEN 'v0.1.0' END AS git_tag, 'data' AS data_hash,
       'Tesla T4' AS gpu_type, 'colab' AS compute_platform, '3.13' AS python_version,
       '2.21' AS tensorflow_version, cast(NULL AS varchar) AS cuda_version, true AS deterministic_ops,
       strftime((SELECT min(ts) FROM events), '%Y-%m-%dT%H:%M:%SZ') AS started_at,
       CASE WHEN is_finished THEN strftime((SELECT max(ts) FROM events), '%Y-%m-%dT%H:%M:%SZ') END AS finished_at,
       is_reported
FROM run_list""",
    "run_list",
)


def eval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Per-image metrics of every run at its folds' thresholds.

    Positives in every fourth column stand in for thin ones, the others for thick ones.
    """
    s = scored_runs(spark, sf)
    base = metrics.evaluate_items(s, ITEM, fold_threshold())
    thin = F.col("col") % 4 == 0
    hit = S.is_positive(F.col("prob"), fold_threshold())
    widths = s.where("in_fov AND label").groupBy(*ITEM).agg(
        S.ratio(F.count_if(hit & thin), F.count_if(thin)).alias("thin_sensitivity"),
        S.ratio(F.count_if(hit & ~thin), F.count_if(~thin)).alias("thick_sensitivity"),
    )
    return base.hint("merge").join(widths, ITEM, "left").withColumn("prediction_mode", F.lit("single"))


cte(
    "counts",
    """SELECT run_id, dataset, image_id, fold, prob,
       count(*) FILTER (label) AS n_pos, count(*) FILTER (NOT label) AS n_neg
FROM scored_runs WHERE in_fov GROUP BY ALL""",
    "scored_runs",
)
cte(
    "running",
    """SELECT *, sum(n_neg) OVER (PARTITION BY run_id, dataset, image_id, fold ORDER BY prob) - n_neg AS neg_below,
       sum(n_pos) OVER (PARTITION BY run_id, dataset, image_id, fold ORDER BY prob DESC) AS tp_at,
       sum(n_neg) OVER (PARTITION BY run_id, dataset, image_id, fold ORDER BY prob DESC) AS fp_at
FROM counts""",
    "counts",
)
cte(
    "areas",
    """SELECT run_id, dataset, image_id, fold,
       cast(sum(n_pos * (2 * neg_below + n_neg)) AS double)
         / nullif(2.0::double * sum(n_pos) * sum(n_neg), 0) AS auc_roc,
       sum(cast(n_pos AS double) * (cast(tp_at AS double) / cast(tp_at + fp_at AS double)))
         / nullif(cast(sum(n_pos) AS double), 0) AS auc_pr
FROM running GROUP BY ALL""",
    "running",
)
cte(
    "confusion",
    f"""SELECT run_id, dataset, image_id, fold,
       count(*) FILTER (hit AND label) AS tp, count(*) FILTER (hit AND NOT label) AS fp,
       count(*) FILTER (NOT hit AND label) AS fn, count(*) FILTER (NOT hit AND NOT label) AS tn,
       avg(pow(cast(prob AS double) - cast(label AS integer), 2)) AS brier
FROM (SELECT *, cast(prob AS double) >= {FOLD_THRESHOLD_SQL} AS hit FROM scored_runs WHERE in_fov)
GROUP BY ALL""",
    "scored_runs",
)
cte(
    "item_metrics",
    f"""SELECT *, {dice_sql('tp', 'fp', 'fn')} AS dice, {ratio_sql('tp', 'tp + fn')} AS sensitivity,
       {ratio_sql('tn', 'tn + fp')} AS specificity, {ratio_sql('tp', 'tp + fp')} AS precision_score,
       {ratio_sql('tp + tn', 'tp + fp + fn + tn')} AS accuracy,
       {ratio_sql('tp + fp', 'tp + fp + fn + tn')} AS predicted_vessel_fraction
FROM confusion""",
    "confusion",
)
cte(
    "stand_in_widths",
    f"""SELECT run_id, dataset, image_id, fold,
       {ratio_sql('count(*) FILTER (hit AND col % 4 = 0)', 'count(*) FILTER (col % 4 = 0)')} AS thin_sensitivity,
       {ratio_sql('count(*) FILTER (hit AND col % 4 <> 0)', 'count(*) FILTER (col % 4 <> 0)')} AS thick_sensitivity
FROM (SELECT *, cast(prob AS double) >= {FOLD_THRESHOLD_SQL} AS hit FROM scored_runs WHERE in_fov AND label)
GROUP BY ALL""",
    "scored_runs",
)
cte(
    "metrics",
    """SELECT b.*, a.auc_roc, a.auc_pr, w.thin_sensitivity, w.thick_sensitivity, 'single' AS prediction_mode
FROM item_metrics b JOIN areas a USING (run_id, dataset, image_id, fold)
LEFT JOIN stand_in_widths w USING (run_id, dataset, image_id, fold)""",
    "item_metrics", "areas", "stand_in_widths",
)


def eval_images(spark: SparkSession, sf: str) -> DataFrame:
    """One image per user, abnormal for every seventh, unlabelled for every eleventh."""
    record = pixels.image_record(scored(spark, sf), ["dataset", "image_id"])
    user = F.col("image_id").cast("bigint")
    labelled = user % 11 != 0
    return record.select(
        "dataset", "image_id",
        F.lit("training").alias("split"),
        (user % 7 == 0).alias("has_abnormality"),
        F.when(user % 7 == 0, F.concat(F.lit("note "), "image_id")).alias("abnormality_note"),
        "fov_pixels",
        F.when(labelled, F.col("positive_pixels")).alias("positive_pixels"),
        F.when(labelled, F.col("vessel_fraction_in_fov")).alias("vessel_fraction_in_fov"),
        labelled.alias("has_labels"),
    )


cte(
    "eval_images",
    f"""SELECT dataset, image_id, 'training' AS split, cast(image_id AS bigint) % 7 = 0 AS has_abnormality,
       CASE WHEN cast(image_id AS bigint) % 7 = 0 THEN 'note ' || image_id END AS abnormality_note,
       count(*) FILTER (in_fov) AS fov_pixels,
       CASE WHEN cast(image_id AS bigint) % 11 <> 0 THEN count(*) FILTER (in_fov AND label) END AS positive_pixels,
       CASE WHEN cast(image_id AS bigint) % 11 <> 0
            THEN {ratio_sql('count(*) FILTER (in_fov AND label)', 'count(*) FILTER (in_fov)')} END
         AS vessel_fraction_in_fov,
       cast(image_id AS bigint) % 11 <> 0 AS has_labels
FROM scored GROUP BY dataset, image_id""",
    "scored",
)


def eval_assignments(spark: SparkSession, sf: str) -> DataFrame:
    """Each run's fold plan over the users; validation is every seventh of (user + fold)."""
    runs = F.array(
        *[F.struct(F.lit(r[0]).alias("id"), F.lit(r[3]).alias("shift")) for r in RUNS]
    )
    users = table(spark, sf, "events").select("user_id").distinct()
    rows = users.withColumn("_r", F.explode(runs)).withColumn(
        "fold", F.explode(F.sequence(F.lit(1), F.lit(N_FOLDS)))
    )
    user = F.col("user_id")
    role = (
        F.when((user + F.col("_r.shift")) % N_FOLDS + 1 == F.col("fold"), "test")
        .when((user + F.col("fold")) % 7 == 0, "val")
        .otherwise("train")
    )
    return rows.select(
        F.col("_r.id").alias("run_id"), "fold", F.lit(DATASET).alias("dataset"),
        user.cast("string").alias("image_id"), role.alias("role"),
    )


cte(
    "eval_assignments",
    """SELECT r.run_id, cast(f.fold AS integer) AS fold, 'drive' AS dataset, cast(u.user_id AS varchar) AS image_id,
       CASE WHEN (u.user_id + r.shift) % 5 + 1 = f.fold THEN 'test'
            WHEN (u.user_id + f.fold) % 7 = 0 THEN 'val' ELSE 'train' END AS role
FROM (SELECT DISTINCT user_id FROM events) u, run_list r, range(1, 6) f(fold)""",
    "run_list",
)


def eval_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {
        "runs": eval_runs(spark, sf),
        "images": eval_images(spark, sf),
        "per_image_metrics": eval_metrics(spark, sf),
        "fold_assignments": eval_assignments(spark, sf),
    }


# ---------------------------------------------------------------- training history from orders


def history(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    month = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")
    cents = F.floor(F.col("o_totalprice") * F.lit(100.0) + F.lit(0.5)).cast("bigint")
    n = F.count("*")
    good = F.floor((F.count_if(F.col("o_orderstatus") == "F") * 100) / n)
    return o.groupBy(
        F.col("o_orderpriority").alias("run_id"),
        (F.col("o_custkey") % N_FOLDS + 1).cast("int").alias("fold"),
        month.cast("int").alias("epoch"),
    ).agg(
        (F.sum(cents).cast("double") / (n * 100).cast("double")).alias("train_loss"),
        (good.cast("double") / F.lit(100.0)).alias("val_dice"),
    )


cte(
    "history",
    """SELECT o_orderpriority AS run_id, cast(o_custkey % 5 + 1 AS integer) AS fold,
       cast((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS integer) AS epoch,
       cast(sum(cast(floor(o_totalprice * 100.0::double + 0.5::double) AS bigint)) AS double)
         / cast(count(*) * 100 AS double) AS train_loss,
       cast((count(*) FILTER (o_orderstatus = 'F') * 100) // count(*) AS double) / 100.0::double AS val_dice
FROM orders GROUP BY ALL""",
)


def history_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    h = history(spark, sf)
    first = F.substring("run_id", 1, 1)
    runs = h.groupBy("run_id").agg(F.max("epoch").alias("_e")).select(
        "run_id",
        F.when(first == "1", "baseline").otherwise("dice_only").alias("variant"),
        first.isin("1", "2").alias("is_reported"),
        F.when(first != "5", F.col("_e").cast("string")).alias("finished_at"),
    )
    thresholds = h.groupBy("run_id", "fold").agg(F.max("val_dice").alias("val_dice")).select(
        "run_id", "fold", fold_threshold().alias("threshold"),
        F.lit(S.selection_rule(100)).alias("selection_rule"), "val_dice",
    )
    return {"runs": runs, "thresholds": thresholds, "training_history": h}


cte(
    "history_runs",
    """SELECT run_id, CASE WHEN run_id LIKE '1%' THEN 'baseline' ELSE 'dice_only' END AS variant,
       substr(run_id, 1, 1) IN ('1', '2') AS is_reported,
       CASE WHEN run_id NOT LIKE '5%' THEN cast(max(epoch) AS varchar) END AS finished_at
FROM history GROUP BY run_id""",
    "history",
)
cte(
    "history_thresholds",
    f"""SELECT run_id, fold, {FOLD_THRESHOLD_SQL} AS threshold,
       'max mean per-image validation Dice over the grid i/100' AS selection_rule, max(val_dice) AS val_dice
FROM history GROUP BY run_id, fold""",
    "history",
)
cte(
    "threshold_log",
    """SELECT run_id, variant, is_reported, fold, threshold, selection_rule, val_dice, finished_at IS NOT NULL AS is_finished,
  first_epoch AS best_epoch, n_epochs
FROM history_thresholds JOIN history_runs USING (run_id)
LEFT JOIN (SELECT run_id, fold, val_dice, min(epoch) AS first_epoch FROM history GROUP BY ALL) USING (run_id, fold, val_dice)
LEFT JOIN (SELECT run_id, fold, max(epoch) AS n_epochs FROM history GROUP BY ALL) USING (run_id, fold)""",
    "history", "history_thresholds", "history_runs",
)


# ---------------------------------------------------------------- registry from orders and lineitem


def reg_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Every order is a run; faults of each kind are spread by its keys."""
    o = table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    stamp = F.date_format("o_orderdate", S.TIMESTAMP_FORMAT)
    end = F.date_format(F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), k % 7200), S.TIMESTAMP_FORMAT)
    config = F.concat(
        F.lit('{"folds": {"n_folds": '), (k % 7 + 1).cast("string"),
        F.lit('}, "training": {"deterministic_ops": '),
        F.when(c % 3 == 0, "false").otherwise("true"), F.lit("}}"),
    )
    return o.select(
        F.concat(F.lit("r"), k.cast("string")).alias("run_id"),
        F.col("o_orderpriority").alias("variant"),
        config.alias("config"),
        F.substring(F.md5(config), 1, 12).alias("config_hash"),
        c.alias("seed"),
        F.concat(F.lit("c"), (c % 50).cast("string")).alias("git_commit"),
        (k % 4 == 0).alias("git_dirty"),
        F.when(k % 3 == 1, F.concat(F.lit("v0.1."), (k % 10).cast("string")))
        .when(k % 3 == 2, F.concat(F.lit("release-"), (k % 10).cast("string")))
        .alias("git_tag"),
        F.col("o_orderstatus").alias("data_hash"),
        F.lit("3.13").alias("python_version"),
        F.lit("2.21").alias("tensorflow_version"),
        F.when(k % 5 != 0, "12.5").alias("cuda_version"),
        F.when(k % 5 == 0, "cpu").otherwise("Tesla T4").alias("gpu_type"),
        F.when(k % 9 == 0, "local").otherwise("colab").alias("compute_platform"),
        (k % 11 != 0).alias("deterministic_ops"),
        F.when(k % 13 == 0, F.concat(F.lit("m"), (k % 26).cast("string"))).alias("frozen_model_id"),
        F.when((k % 13 == 0) & (k % 2 == 0), (k % 150).cast("double") / F.lit(100.0)).alias("applied_threshold"),
        F.when(k % 17 == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise(stamp).alias("started_at"),
        F.when(F.col("o_orderstatus") != "O", end).alias("finished_at"),
        (k % 6 == 1).alias("is_reported"),
    )


cte(
    "reg_runs",
    """SELECT 'r' || o_orderkey AS run_id, o_orderpriority AS variant, config,
       substr(md5(config), 1, 12) AS config_hash, o_custkey AS seed, 'c' || (o_custkey % 50) AS git_commit,
       o_orderkey % 4 = 0 AS git_dirty,
       CASE WHEN o_orderkey % 3 = 1 THEN 'v0.1.' || (o_orderkey % 10)
            WHEN o_orderkey % 3 = 2 THEN 'release-' || (o_orderkey % 10) END AS git_tag,
       o_orderstatus AS data_hash, '3.13' AS python_version, '2.21' AS tensorflow_version,
       CASE WHEN o_orderkey % 5 <> 0 THEN '12.5' END AS cuda_version,
       CASE WHEN o_orderkey % 5 = 0 THEN 'cpu' ELSE 'Tesla T4' END AS gpu_type,
       CASE WHEN o_orderkey % 9 = 0 THEN 'local' ELSE 'colab' END AS compute_platform,
       o_orderkey % 11 <> 0 AS deterministic_ops,
       CASE WHEN o_orderkey % 13 = 0 THEN 'm' || (o_orderkey % 26) END AS frozen_model_id,
       CASE WHEN o_orderkey % 13 = 0 AND o_orderkey % 2 = 0
            THEN cast(o_orderkey % 150 AS double) / 100.0::double END AS applied_threshold,
       CASE WHEN o_orderkey % 17 = 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
            ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END AS started_at,
       CASE WHEN o_orderstatus <> 'O'
            THEN strftime(o_orderdate + to_seconds(o_orderkey % 7200), '%Y-%m-%dT%H:%M:%SZ') END AS finished_at,
       o_orderkey % 6 = 1 AS is_reported
FROM (SELECT *, '{"folds": {"n_folds": ' || (o_orderkey % 7 + 1) || '}, "training": {"deterministic_ops": '
             || CASE WHEN o_custkey % 3 = 0 THEN 'false' ELSE 'true' END || '}}' AS config FROM orders)""",
)


def reg_status_events(spark: SparkSession, sf: str) -> DataFrame:
    """Every order line is an attempt at one fold; its number is its rank by time and part."""
    li = table(spark, sf, "lineitem")
    done = F.col("l_linestatus") == "F"
    return li.select(
        F.concat(F.lit("r"), F.col("l_orderkey").cast("string")).alias("run_id"),
        F.col("l_linenumber").alias("fold"),
        F.when(done, "complete").otherwise("running").alias("status"),
        F.when(done, F.md5(F.col("l_partkey").cast("string"))).alias("checkpoint_sha256"),
        F.date_format("l_shipdate", S.TIMESTAMP_FORMAT).alias("started_at"),
        F.when(done, F.date_format("l_shipdate", S.TIMESTAMP_FORMAT)).alias("completed_at"),
        (F.col("l_quantity").cast("int") * 100000 + F.col("l_partkey") % 100000).cast("int").alias("attempts"),
    )


cte(
    "reg_status_events",
    """SELECT 'r' || l_orderkey AS run_id, l_linenumber AS fold,
       CASE WHEN l_linestatus = 'F' THEN 'complete' ELSE 'running' END AS status,
       CASE WHEN l_linestatus = 'F' THEN md5(cast(l_partkey AS varchar)) END AS checkpoint_sha256,
       strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') AS started_at,
       CASE WHEN l_linestatus = 'F' THEN strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') END AS completed_at,
       cast(cast(l_quantity AS integer) * 100000 + l_partkey % 100000 AS integer) AS attempts
FROM lineitem""",
)
cte(
    "reg_status",
    """SELECT * EXCLUDE (place) FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, fold ORDER BY attempts DESC, status = 'complete' DESC,
    started_at DESC, checkpoint_sha256 DESC NULLS LAST) AS place FROM reg_status_events)
WHERE place = 1""",
    "reg_status_events",
)


def reg_dataset(supplier):
    """Images 30 to 39 belong to a second dataset."""
    return F.when(supplier % 40 < 30, DATASET).otherwise("stare")


def reg_assignments(spark: SparkSession, sf: str) -> DataFrame:
    """Every order line assigns one of forty images a role, so leaks arise by themselves."""
    li = table(spark, sf, "lineitem")
    role = F.when(F.col("l_returnflag") == "A", "train").when(F.col("l_returnflag") == "R", "val").otherwise("test")
    return li.select(
        F.concat(F.lit("r"), F.col("l_orderkey").cast("string")).alias("run_id"),
        (F.col("l_linenumber") % 3 + 1).cast("int").alias("fold"),
        reg_dataset(F.col("l_suppkey")).alias("dataset"),
        F.concat(F.lit("i"), (F.col("l_suppkey") % 40).cast("string")).alias("image_id"),
        role.alias("role"),
    )


cte(
    "reg_assignments",
    """SELECT 'r' || l_orderkey AS run_id, cast(l_linenumber % 3 + 1 AS integer) AS fold, CASE WHEN l_suppkey % 40 < 30 THEN 'drive' ELSE 'stare' END AS dataset,
       'i' || (l_suppkey % 40) AS image_id,
       CASE l_returnflag WHEN 'A' THEN 'train' WHEN 'R' THEN 'val' ELSE 'test' END AS role
FROM lineitem""",
)


def reg_images(spark: SparkSession, sf: str) -> DataFrame:
    """Images named by suppliers; every fifth has no labels."""
    key = F.col("s_suppkey") % 40
    return (
        table(spark, sf, "supplier")
        .groupBy(key.alias("k"))
        .agg(F.count("*").alias("fov_pixels"))
        .select(
            reg_dataset(F.col("k")).alias("dataset"), F.concat(F.lit("i"), F.col("k").cast("string")).alias("image_id"),
            "fov_pixels", (F.col("k") % 5 != 0).alias("has_labels"),
        )
    )


cte(
    "reg_images",
    """SELECT CASE WHEN s_suppkey % 40 < 30 THEN 'drive' ELSE 'stare' END AS dataset, 'i' || (s_suppkey % 40) AS image_id, count(*) AS fov_pixels,
       (s_suppkey % 40) % 5 <> 0 AS has_labels
FROM supplier GROUP BY s_suppkey % 40""",
)


def reg_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """One metric row per run and image with a line; some not evaluated."""
    li = table(spark, sf, "lineitem")
    key = ["run_id", "dataset", "image_id"]
    lines = li.select(
        F.concat(F.lit("r"), F.col("l_orderkey").cast("string")).alias("run_id"),
        reg_dataset(F.col("l_suppkey")).alias("dataset"),
        F.concat(F.lit("i"), (F.col("l_suppkey") % 40).cast("string")).alias("image_id"),
        "l_discount", "l_tax",
    )
    # Hardly two lines share a key, so map tasks would hold all their rows.
    return (
        spread(lines, key, li.count()).groupBy(*key)
        .agg(F.max("l_discount").alias("d"), F.max("l_tax").alias("x"))
        .select(
            "run_id", "dataset", "image_id", F.lit("single").alias("prediction_mode"),
            F.when(F.col("d") > 0.01, F.col("d")).alias("brier"), (F.col("x") * 20).alias("dice"),
        )
    )


cte(
    "reg_metrics",
    """SELECT 'r' || l_orderkey AS run_id, CASE WHEN l_suppkey % 40 < 30 THEN 'drive' ELSE 'stare' END AS dataset, 'i' || (l_suppkey % 40) AS image_id,
       'single' AS prediction_mode,
       CASE WHEN max(l_discount) > 0.01 THEN max(l_discount) END AS brier, max(l_tax) * 20 AS dice
FROM lineitem GROUP BY l_orderkey, l_suppkey % 40""",
)


def reg_evaluations(spark: SparkSession, sf: str) -> DataFrame:
    """Two of three runs were evaluated, some by another or a dirty checkout; the third's row says nothing."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    commit = F.concat(F.lit("c"), ((F.col("o_custkey") + F.when(k % 7 == 0, 1).otherwise(0)) % 50).cast("string"))
    return o.select(
        F.concat(F.lit("r"), k.cast("string")).alias("run_id"),
        F.when(k % 3 != 0, commit).alias("commit"),
        F.when(k % 3 != 0, k % 8 == 0).alias("dirty"),
    )


cte(
    "reg_evaluations",
    """SELECT 'r' || o_orderkey AS run_id,
       CASE WHEN o_orderkey % 3 <> 0 THEN 'c' || ((o_custkey + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END) % 50) END AS commit,
       CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 8 = 0 END AS dirty
FROM orders""",
)


def reg_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """Checkpoints of every run and fold: the largest digest of its finished lines, some of them lost or changed."""
    li = table(spark, sf, "lineitem")
    digest = F.max(F.when(F.col("l_linestatus") == "F", F.md5(F.col("l_partkey").cast("string"))))
    return li.groupBy("l_orderkey", "l_linenumber").agg(digest.alias("d")).select(
        F.concat(F.lit("r"), F.col("l_orderkey").cast("string")).alias("run_id"),
        F.col("l_linenumber").alias("fold"),
        F.when(F.col("l_orderkey") % 12 == 1, F.md5("d")).when(F.col("l_orderkey") % 10 != 0, F.col("d")).alias("digest"),
    )


cte(
    "reg_artifacts",
    """SELECT 'r' || l_orderkey AS run_id, l_linenumber AS fold,
       CASE WHEN l_orderkey % 12 = 1 THEN md5(d) WHEN l_orderkey % 10 <> 0 THEN d END AS digest
FROM (SELECT l_orderkey, l_linenumber, max(CASE WHEN l_linestatus = 'F' THEN md5(cast(l_partkey AS varchar)) END) AS d
  FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
)


# ---------------------------------------------------------------- images from embeddings


def grid_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Every embedding is an 8 x 8 image with a round mask."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), "embedding")
    p = pixels.pixels_from_arrays(e, ["image_id"], "embedding", F.lit(8))
    x = F.col("value").cast("double")
    dr, dc = 2 * F.col("row") - 7, 2 * F.col("col") - 7
    return p.select(
        "image_id", (F.col("image_id") % N_FOLDS + 1).cast("int").alias("fold"), "row", "col",
        x.alias("x"),
        F.least(F.greatest(x + F.lit(0.6), F.lit(0.0)), F.lit(1.0)).cast("float").alias("prob"),
        (x > -0.15).alias("label"),
        (dr * dr + dc * dc <= 64).alias("in_fov"),
    )


cte(
    "grid_pixels",
    """SELECT image_id, cast(image_id % 5 + 1 AS integer) AS fold, cast(pos // 8 AS integer) AS row,
       cast(pos % 8 AS integer) AS col, x,
       cast(least(greatest(x + 0.6::double, 0.0::double), 1.0::double) AS float) AS prob,
       x > -0.15::double AS label,
       (2 * (pos // 8) - 7) * (2 * (pos // 8) - 7) + (2 * (pos % 8) - 7) * (2 * (pos % 8) - 7) <= 64 AS in_fov
FROM (SELECT vec_id AS image_id, unnest(range(0, 64)) AS pos,
             cast(unnest(embedding) AS double) AS x FROM embeddings)""",
)


def rgb_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Three shifted readings of an embedding, as 8-bit channels of an 8 x 8 image."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), "embedding")

    def level(shift: int):
        v = F.element_at("embedding", ((F.col("_pos") + shift) % 64 + 1)).cast("double")
        unit = F.least(F.greatest((v + F.lit(0.4)) / F.lit(0.8), F.lit(0.0)), F.lit(0.999999))
        return F.floor(unit * F.lit(256.0)).cast("int")

    spread = e.select("image_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("_pos"))
    row, col = F.floor(F.col("_pos") / F.lit(8)).cast("int"), (F.col("_pos") % 8).cast("int")
    dr, dc = 2 * row - 7, 2 * col - 7
    return spread.select(
        "image_id", row.alias("row"), col.alias("col"),
        level(0).alias("r"), level(21).alias("g"), level(42).alias("b"),
        (dr * dr + dc * dc <= 64).alias("in_fov"),
    )


def _level_sql(shift: int) -> str:
    v = f"cast(embedding[(pos + {shift}) % 64 + 1] AS double)"
    return (
        f"cast(floor(least(greatest(({v} + 0.4::double) / 0.8::double, 0.0::double), 0.999999::double)"
        " * 256.0::double) AS integer)"
    )


cte(
    "rgb_pixels",
    f"""SELECT vec_id AS image_id, cast(pos // 8 AS integer) AS row, cast(pos % 8 AS integer) AS col,
       {_level_sql(0)} AS r, {_level_sql(21)} AS g, {_level_sql(42)} AS b,
       (2 * (pos // 8) - 7) * (2 * (pos // 8) - 7) + (2 * (pos % 8) - 7) * (2 * (pos % 8) - 7) <= 64 AS in_fov
FROM embeddings, range(0, 64) t(pos)""",
)


# ---------------------------------------------------------------- manifests from documents


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(
        "doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"),
        F.sha2("text", 256).alias("digest"),
    )


def files(spark: SparkSession, sf: str) -> DataFrame:
    """The manifest with seeded faults: lost, changed and added files."""
    m = manifest(spark, sf).where("doc_id % 7 <> 0")
    changed = m.select("path", F.when(F.col("doc_id") % 11 == 0, F.sha2("digest", 256)).otherwise(F.col("digest")).alias("digest"))
    added = m.where("doc_id % 13 = 0").select(F.concat("path", F.lit(".new")).alias("path"), "digest")
    return changed.unionByName(added)


cte("manifest", "SELECT doc_id, source || '/' || doc_id AS path, sha256(text) AS digest FROM documents")
cte(
    "files",
    """SELECT path, CASE WHEN doc_id % 11 = 0 THEN sha256(digest) ELSE digest END AS digest
FROM manifest WHERE doc_id % 7 <> 0
UNION ALL SELECT path || '.new', digest FROM manifest WHERE doc_id % 7 <> 0 AND doc_id % 13 = 0""",
    "manifest",
)


def images_meta(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as image records, with the faults their labels bring along."""
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    joined = d.join(lab, "doc_id", "left")
    k = F.col("doc_id")
    toxic = F.coalesce(F.col("toxic") == 1, F.lit(False))
    return joined.select(
        F.when(F.col("lang") == "en", "drive").when(F.col("lang") == "fr", "stare")
        .when(F.col("lang") == "de", "chase").otherwise(F.col("lang")).alias("dataset"),
        k.cast("string").alias("image_id"),
        F.when(k % 9 == 0, "held").when(k % 2 == 0, "test").otherwise("training").alias("split"),
        (toxic | (k % 31 == 0)).alias("has_abnormality"),
        F.when(toxic, F.col("source")).when(k % 37 == 0, "").alias("abnormality_note"),
        F.when(k % 23 == 0, 0).otherwise(F.col("n_chars")).cast("bigint").alias("fov_pixels"),
        F.when(k % 2 == 0, "official").otherwise("generated").alias("fov_source"),
        F.when(k % 3 != 0, F.col("n_chars").cast("double") / F.lit(9000.0)).alias("vessel_fraction_in_fov"),
        F.col("quality").isNotNull().alias("has_labels"),
    )


cte(
    "images_meta",
    """SELECT CASE lang WHEN 'en' THEN 'drive' WHEN 'fr' THEN 'stare' WHEN 'de' THEN 'chase' ELSE lang END AS dataset,
       cast(d.doc_id AS varchar) AS image_id,
       CASE WHEN d.doc_id % 9 = 0 THEN 'held' WHEN d.doc_id % 2 = 0 THEN 'test' ELSE 'training' END AS split,
       coalesce(toxic = 1, false) OR d.doc_id % 31 = 0 AS has_abnormality,
       CASE WHEN coalesce(toxic = 1, false) THEN source WHEN d.doc_id % 37 = 0 THEN '' END AS abnormality_note,
       CASE WHEN d.doc_id % 23 = 0 THEN 0 ELSE n_chars END AS fov_pixels,
       CASE WHEN d.doc_id % 2 = 0 THEN 'official' ELSE 'generated' END AS fov_source,
       CASE WHEN d.doc_id % 3 <> 0 THEN cast(n_chars AS double) / 9000.0::double END AS vessel_fraction_in_fov,
       quality IS NOT NULL AS has_labels
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
