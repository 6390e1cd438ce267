"""Confusion metrics, rank areas, calibration and threshold choice inside the mask.

Input is the long table ``scored_pixels``: one row per pixel with ``prob FLOAT``,
``label BOOLEAN`` and ``in_fov BOOLEAN``. ``keys`` name the item (run and image, say), and every
function returns one row per item unless it says otherwise.

``score_counts`` is the shared first step of the rank and sweep metrics: it reduces the pixels to
positives and negatives per distinct score with map-side partial aggregation, so a score that
fills a third of the table (0 outside vessels, say) becomes one row per task before any shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskaudit.functions import scalars as S

MASKED_COUNTS = ("tp", "fp", "fn", "tn")


def require_float_scores(scored: DataFrame, column: str = "prob") -> None:
    """Scores are stored as FLOAT and compared as DOUBLE; anything else is refused."""
    kind = scored.schema[column].dataType
    if not isinstance(kind, T.FloatType):
        raise ValueError(f"{column} must be float, got {kind.simpleString()}")


def valid_scores(scored: DataFrame) -> DataFrame:
    """Return the pixels inside the mask; a score that is missing, not finite or outside [0, 1] stops the job."""
    require_float_scores(scored)
    p = F.col("prob").cast("double")
    message = F.concat(F.lit("score outside [0, 1]: "), F.coalesce(p.cast("string"), F.lit("missing")))
    strict = F.when(p.between(0.0, 1.0), F.col("prob")).otherwise(F.raise_error(message).cast("float"))
    return scored.where("in_fov").withColumn("prob", strict)


def confusion_counts(
    scored: DataFrame, keys: Sequence[str], threshold: Column, weight: Column | None = None
) -> DataFrame:
    """Count true and false positives and negatives inside the mask."""
    w = F.lit(1) if weight is None else weight
    hit, label = S.is_positive(F.col("prob"), threshold), F.col("label")

    def count(cond: Column) -> Column:
        return F.sum(F.when(cond, w).otherwise(F.lit(0))).cast("bigint")

    return valid_scores(scored).groupBy(*keys).agg(
        count(hit & label).alias("tp"),
        count(hit & ~label).alias("fp"),
        count(~hit & label).alias("fn"),
        count(~hit & ~label).alias("tn"),
    )


def binary_metrics(counts: DataFrame) -> DataFrame:
    """Add dice, sensitivity, specificity, precision, accuracy and predicted fraction."""
    tp, fp, fn, tn = (F.col(c) for c in MASKED_COUNTS)
    total = tp + fp + fn + tn
    return counts.select(
        *[c for c in counts.columns if c not in MASKED_COUNTS],
        *MASKED_COUNTS,
        S.dice(tp, fp, fn).alias("dice"),
        S.ratio(tp, tp + fn).alias("sensitivity"),
        S.ratio(tn, tn + fp).alias("specificity"),
        S.ratio(tp, tp + fp).alias("precision_score"),
        S.ratio(tp + tn, total).alias("accuracy"),
        S.ratio(tp + fp, total).alias("predicted_vessel_fraction"),
    )


def brier(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean squared difference between score and label inside the mask."""
    gap = F.col("prob").cast("double") - F.col("label").cast("double")
    return valid_scores(scored).groupBy(*keys).agg(F.avg(gap * gap).alias("brier"))


def score_counts(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Positives and negatives at each distinct score of each item, inside the mask."""
    return valid_scores(scored).groupBy(*keys, "prob").agg(
        F.count_if(F.col("label")).alias("n_pos"),
        F.count_if(~F.col("label")).alias("n_neg"),
    )


def rank_metrics(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tie-aware ROC area and average precision from ``score_counts``.

    The running sums over scores are taken in two levels: inside a bounded bucket of scores, and
    over the bucket totals of an item. Pooled over everything (``keys`` empty) it is the same plan,
    and neither window ever holds more rows than ``score_bucket`` allows.
    """
    item = [*keys] or [F.lit(0)]
    bucketed = counts.withColumn("_b", S.score_bucket(F.col("prob")))
    totals = bucketed.groupBy(*keys, "_b").agg(
        F.sum("n_pos").alias("_bp"), F.sum("n_neg").alias("_bn")
    )
    whole = Window.partitionBy(*item)
    before = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        "_b",
        F.coalesce(F.sum("_bp").over(before), F.lit(0)).alias("_op"),
        F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_on"),
        F.sum("_bp").over(whole).alias("_vp"),
        F.sum("_bn").over(whole).alias("_vn"),
    )
    inside = (
        Window.partitionBy(*keys, "_b").orderBy("prob").rowsBetween(Window.unboundedPreceding, -1)
    )
    # Spark does not count what an explode adds and could take either side, a row per score, for small enough to broadcast.
    rows = bucketed.hint("merge").join(offsets, [*keys, "_b"]).select(
        *keys,
        "n_pos",
        "n_neg",
        "_vp",
        "_vn",
        (F.col("_op") + F.coalesce(F.sum("n_pos").over(inside), F.lit(0))).alias("_pos_below"),
        (F.col("_on") + F.coalesce(F.sum("n_neg").over(inside), F.lit(0))).alias("_neg_below"),
    )
    v, b = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    n_pos, n_neg = F.max("_vp").cast("double"), F.max("_vn").cast("double")
    tp = (F.col("_vp") - F.col("_pos_below")).cast("double")
    fp = (F.col("_vn") - F.col("_neg_below")).cast("double")
    # Twice the pairs won, so that half a tie stays a whole number.
    won = F.sum(v * (F.lit(2.0) * F.col("_neg_below").cast("double") + b))
    return rows.groupBy(*keys).agg(
        F.max("_vp").alias("n_pos"),
        F.max("_vn").alias("n_neg"),
        F.try_divide(won, F.lit(2.0) * n_pos * n_neg).alias("auc_roc"),
        F.try_divide(F.sum(v * (tp / (tp + fp))), n_pos).alias("auc_pr"),
    )


def zero_filled(
    binned: DataFrame, keys: Sequence[str], slot: str, first: int, last: int, sums: Sequence[str]
) -> DataFrame:
    """Give every item one row per slot in ``first..last``; slots without rows sum to zero.

    Zero rows are added once per item and summed together with the real ones, so the grid is
    never joined to pixels and pooled use (``keys`` empty) needs no special case.
    """
    slots = F.explode(F.sequence(F.lit(first).cast("bigint"), F.lit(last).cast("bigint")))
    items = binned.groupBy(*keys).agg(F.count("*").alias("_rows"))
    empty = items.where(F.col("_rows") > 0).select(*keys, slots.alias(slot)).select(
        *keys, slot, *[F.lit(0).cast(binned.schema[s].dataType).alias(s) for s in sums]
    )
    return (
        binned.select(*keys, slot, *sums)
        .unionByName(empty)
        .groupBy(*keys, slot)
        .agg(*[F.sum(s).alias(s) for s in sums])
    )


def reliability(scored: DataFrame, keys: Sequence[str], n_bins: int) -> DataFrame:
    """One row per item and bin with counts, mean score and positive fraction."""
    p, y = F.col("prob").cast("double"), F.col("label").cast("double")
    binned = (
        valid_scores(scored)
        .groupBy(*keys, S.reliability_bin(F.col("prob"), n_bins).alias("bin"))
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col("label")).alias("n_pos"),
            F.sum(p).alias("sum_prob"),
            F.sum((p - y) * (p - y)).alias("sum_sq"),
        )
    )
    sums = ["n", "n_pos", "sum_prob", "sum_sq"]
    filled = zero_filled(binned, keys, "bin", 0, n_bins - 1, sums)
    # n_bins rows per item: a window over the summary, never over pixels.
    whole = Window.partitionBy(*([*keys] or [F.lit(0)]))
    n = F.lit(float(n_bins))
    return filled.select(
        *keys,
        "bin",
        (F.col("bin").cast("double") / n).alias("edge_low"),
        ((F.col("bin") + 1).cast("double") / n).alias("edge_high"),
        F.col("n").alias("n_pixels"),
        F.try_divide(F.col("sum_prob"), F.col("n").cast("double")).alias("mean_probability"),
        S.ratio(F.col("n_pos"), F.col("n")).alias("vessel_fraction"),
        (F.sum("sum_sq").over(whole) / F.sum("n").over(whole).cast("double")).alias("pooled_brier"),
    )


def grid_counts(scored: DataFrame, keys: Sequence[str], divisions: int) -> DataFrame:
    """Positives and negatives at or above every grid threshold ``k / divisions``."""
    binned = (
        valid_scores(scored)
        .groupBy(*keys, S.grid_index(F.col("prob"), divisions).alias("k"))
        .agg(
            F.count_if(F.col("label")).alias("n_pos"),
            F.count_if(~F.col("label")).alias("n_neg"),
        )
    )
    # A bin stands for the thresholds down to the next lower bin of its item, the highest one also for those above it, which
    # no score reaches. So windows hold the bins there are, and thresholds are listed last, one row at a time.
    item = Window.partitionBy(*([*keys] or [F.lit(0)]))
    down = item.orderBy(F.desc("k"))
    upto = down.rowsBetween(Window.unboundedPreceding, 0)
    placed = binned.select(
        *keys,
        F.col("k").alias("_bin"),
        F.sum("n_pos").over(upto).alias("_pos"),
        F.sum("n_neg").over(upto).alias("_neg"),
        F.sum("n_pos").over(item).alias("_all"),
        F.coalesce(F.lead("k").over(down) + 1, F.lit(1)).alias("_low"),
        F.when(F.lag("k").over(down).isNull(), F.lit(divisions - 1)).otherwise(F.least("k", F.lit(divisions - 1))).alias("_high"),
    )
    nothing = F.lit(0).cast("bigint")
    reached = F.col("k") <= F.col("_bin")
    return (
        placed.where("_low <= _high")
        .withColumn("k", F.explode(F.sequence(F.col("_low").cast("bigint"), F.col("_high").cast("bigint"))))
        .select(
            *keys,
            "k",
            (F.col("k").cast("double") / F.lit(float(divisions))).alias("threshold"),
            F.when(reached, F.col("_pos")).otherwise(nothing).alias("tp"),
            F.when(reached, F.col("_neg")).otherwise(nothing).alias("fp"),
            F.when(reached, F.col("_all") - F.col("_pos")).otherwise(F.col("_all")).alias("fn"),
        )
    )


def threshold_sweep(scored: DataFrame, keys: Sequence[str], divisions: int) -> DataFrame:
    """Dice of ``prob >= k / divisions`` for every grid threshold, in one pass."""
    return grid_counts(scored, keys, divisions).withColumn(
        "dice", S.dice(F.col("tp"), F.col("fp"), F.col("fn"))
    )


def best_threshold(sweep: DataFrame, fold_keys: Sequence[str], divisions: int) -> DataFrame:
    """The threshold with the highest mean per-image dice; ties go to the lowest.

    Means are compared as sums of dice in units of 1e-12, so the choice does not depend on the
    order in which tasks add doubles.
    """
    units = F.floor(F.col("dice") * F.lit(1e12) + F.lit(0.5)).cast("decimal(20,0)")
    means = sweep.groupBy(*fold_keys, "k", "threshold").agg(
        F.sum(units).alias("_total"),
        F.avg("dice").alias("val_dice"),
        F.count("*").alias("n_images"),
    )
    best = Window.partitionBy(*fold_keys).orderBy(F.desc("_total"), F.asc("k"))
    return (
        means.withColumn("_rn", F.row_number().over(best))
        .where("_rn = 1")
        .select(
            *fold_keys,
            "threshold",
            "val_dice",
            "n_images",
            F.lit(S.selection_rule(divisions)).alias("selection_rule"),
        )
    )


def evaluate_items(scored: DataFrame, keys: Sequence[str], threshold: Column) -> DataFrame:
    """Every per-item metric from a single scan and a single shuffle of the pixels.

    Confusion counts, Brier, ROC and precision-recall areas are all functions of the positives and
    negatives per distinct score, so each branch starts from the same ``score_counts`` exchange.
    ``threshold`` may use the key columns only.
    """
    counts = score_counts(scored, keys)
    p = F.col("prob").cast("double")
    hit = S.is_positive(F.col("prob"), threshold)
    pos, neg = F.col("n_pos"), F.col("n_neg")

    def when(cond: Column, value: Column) -> Column:
        return F.sum(F.when(cond, value).otherwise(F.lit(0))).cast("bigint")

    squared = pos * (p - 1.0) * (p - 1.0) + neg * p * p
    simple = counts.groupBy(*keys).agg(
        when(hit, pos).alias("tp"),
        when(hit, neg).alias("fp"),
        when(~hit, pos).alias("fn"),
        when(~hit, neg).alias("tn"),
        (F.sum(squared) / F.sum(pos + neg).cast("double")).alias("brier"),
    )
    areas = rank_metrics(counts, keys).drop("n_pos", "n_neg")
    return binary_metrics(simple).hint("merge").join(areas, [*keys])


def score_validity(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items whose scores are missing, not finite, outside [0, 1], or not a full rectangle."""
    p = F.col("prob").cast("double")
    bad = p.isNull() | F.isnan(p) | ~p.between(0.0, 1.0)
    height, width = F.max("row") + 1, F.max("col") + 1
    return scored.groupBy(*keys).agg(
        F.count_if(F.coalesce(bad, F.lit(True))).alias("n_bad"),
        height.cast("bigint").alias("height"),
        width.cast("bigint").alias("width"),
        F.count("*").alias("n_pixels"),
        (F.count("*") == height.cast("bigint") * width.cast("bigint")).alias("is_full"),
    )


def empty_masks(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """B1: items without a single pixel inside the mask, which no metric can be computed for."""
    return (
        pixels.groupBy(*keys)
        .agg(F.count_if(F.col("in_fov")).alias("fov_pixels"))
        .where("fov_pixels = 0")
        .select(*keys)
    )
