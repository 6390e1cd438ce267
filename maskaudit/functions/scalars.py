"""Scalar rules shared by the operators: ratios, exact bins, masks, text and time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"
# The release-tag and digest patterns.
RELEASE_TAG = r"^v\d+\.\d+\.\d+(-[0-9A-Za-z.]+)?$"
MANIFEST_LINE = r"^([0-9a-f]{64})  (.+)$"
SELECTION_RULE = "max mean per-image validation Dice over the grid i/{divisions}"
# The luma weights of red, green and blue.
LUMA = (0.299, 0.587, 0.114)


def ratio(num: Column, den: Column) -> Column:
    """Return ``num / den`` as DOUBLE, NULL when the denominator is zero."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def dice(tp: Column, fp: Column, fn: Column) -> Column:
    """Return 2TP / (2TP + FP + FN), and 1 when neither side marks a pixel."""
    den = 2 * tp + fp + fn
    return F.when(den == 0, F.lit(1.0)).otherwise((2 * tp).cast("double") / den.cast("double"))


def is_positive(prob: Column, threshold: Column) -> Column:
    """Return ``prob >= threshold`` in double precision; equality counts as positive."""
    return prob.cast("double") >= threshold.cast("double")


def grid_index(prob: Column, divisions: int) -> Column:
    """Return the largest k with ``k / divisions <= prob``.

    ``floor(prob * divisions)`` alone is off by one for scores such as 0.29 and 0.57, so the
    two neighbouring edges are compared as the quotients the grid itself is made of.
    """
    if divisions < 2:
        raise ValueError(f"divisions must be at least 2, got {divisions}")
    p = prob.cast("double")
    k = F.floor(p * F.lit(float(divisions)))
    n = F.lit(float(divisions))
    return (
        F.when((k + 1).cast("double") / n <= p, k + 1)
        .when(k.cast("double") / n > p, k - 1)
        .otherwise(k)
        .cast("bigint")
    )


def reliability_bin(prob: Column, n_bins: int) -> Column:
    """Return the equal-width bin of a score; the last bin also holds 1."""
    return F.least(grid_index(prob, n_bins), F.lit(n_bins - 1).cast("bigint"))


def outcome(predicted: Column, label: Column, in_fov: Column) -> Column:
    """Name the outcome of a pixel: tp, fp, fn, or rest (true negative or outside the mask)."""
    return (
        F.when(predicted & label & in_fov, F.lit("tp"))
        .when(predicted & ~label & in_fov, F.lit("fp"))
        .when(~predicted & label & in_fov, F.lit("fn"))
        .otherwise(F.lit("rest"))
    )


def luma(r: Column, g: Column, b: Column) -> Column:
    """Return the 8-bit gray value of an RGB pixel."""
    wr, wg, wb = (F.lit(w) for w in LUMA)
    return F.floor(wr * r + wg * g + wb * b + F.lit(0.5)).cast("int")


def padded_id(number: Column, width: int = 2) -> Column:
    """Format a number as a zero-padded id."""
    return F.format_string(f"%0{width}d", number.cast("bigint"))


def format_na(value: Column, decimals: int) -> Column:
    """Format with a fixed count of decimals, and a missing value as NA."""
    text = F.format_string(f"%.{decimals}f", value.cast("double"))
    return F.when(value.isNotNull(), text).otherwise(F.lit("NA"))


def path_prefix(path: Column) -> Column:
    """Return the first component of a slash-separated path."""
    return F.split_part(path, F.lit("/"), F.lit(1))


def is_release_tag(tag: Column) -> Column:
    return tag.rlike(RELEASE_TAG)


def timestamp_ok(text: Column) -> Column:
    """Tell whether a text timestamp survives a parse and format round trip; NULL stays NULL."""
    parsed = F.try_to_timestamp(text, F.lit(TIMESTAMP_FORMAT))
    same = F.coalesce(F.date_format(parsed, TIMESTAMP_FORMAT) == text, F.lit(False))
    return F.when(text.isNotNull(), same)


def minutes_between(start: Column, end: Column) -> Column:
    """Return whole minutes between two text timestamps, halves to the even minute."""
    seconds = [
        F.unix_timestamp(F.try_to_timestamp(t, F.lit(TIMESTAMP_FORMAT))) for t in (end, start)
    ]
    return F.bround((seconds[0] - seconds[1]) / F.lit(60.0), 0).cast("bigint")


def run_id_text(started: Column, token: Column) -> Column:
    """Return a run id that sorts by start time: ``YYYYmmddTHHMMSSZ-hex6``."""
    stamp = F.date_format(started, "yyyyMMdd'T'HHmmss'Z'")
    return F.concat(stamp, F.lit("-"), F.substring(F.md5(token.cast("string")), 1, 6))


def selection_rule(divisions: int) -> str:
    return SELECTION_RULE.format(divisions=divisions)


def score_bucket(prob: Column) -> Column:
    """Return a monotone bucket of a FLOAT score in [0, 1] that holds a bounded number of values.

    A float has 2**23 steps per octave, so 16 log-spaced buckets per octave leave at most 800,000
    distinct scores in one, and the 150 octaves of [0, 1] give at most 2,400 buckets. Both bounds
    hold whatever the distribution of scores.
    """
    p = prob.cast("double")
    return (
        F.when(p <= 0, F.lit(-(1 << 20)))
        # Never NULL: a nullable bucket as a join key would put a filter into one branch of the
        # plan only, and the branches could no longer share their scan and shuffle.
        .otherwise(F.coalesce(F.floor(F.log2(p) * F.lit(16.0)), F.lit(0)))
        .cast("int")
    )
