"""Mask-weighted training losses as grouped sums.

Input rows carry ``y`` (label), ``p`` (score) and ``w`` (mask weight), all numeric.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: scores are kept this far from 0 and 1 before taking logarithms.
EPSILON = 1e-7


def soft_dice_expr(smooth: float) -> Column:
    """1 minus the soft dice of the group, pooled over every weighted pixel."""
    y, p, w = F.col("y"), F.col("p"), F.col("w")
    overlap = F.sum(w * y * p)
    total = F.sum(w * y) + F.sum(w * p)
    s = F.lit(smooth)
    return F.lit(1.0) - (F.lit(2.0) * overlap + s) / (total + s)


def masked_bce_expr() -> Column:
    """Cross-entropy averaged over the weighted pixels; 0 for a group without any."""
    y, w = F.col("y"), F.col("w")
    p = F.least(F.greatest(F.col("p"), F.lit(EPSILON)), F.lit(1.0 - EPSILON))
    bce = -(y * F.ln(p) + (F.lit(1.0) - y) * F.ln(F.lit(1.0) - p))
    return F.sum(w * bce) / F.greatest(F.sum(w), F.lit(1.0))


def loss_expr(name: str, smooth: float = 1.0) -> Column:
    """The named loss, ``dice`` or ``bce_dice``."""
    if name == "dice":
        return soft_dice_expr(smooth)
    if name == "bce_dice":
        return masked_bce_expr() + soft_dice_expr(smooth)
    raise ValueError(f"unknown loss {name!r}")


def batch_loss(batches: DataFrame, keys: Sequence[str], name: str, smooth: float = 1.0) -> DataFrame:
    return batches.groupBy(*keys).agg(loss_expr(name, smooth).alias("loss"))


def pack_target(batches: DataFrame) -> DataFrame:
    """Pair every label with its weight in one column."""
    return batches.withColumn("target", F.struct("y", "w"))
