"""From array images to pixel rows, image records, and the preprocessing chain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskaudit.functions import scalars as S
from maskaudit.operators.equalize import equalize
from maskaudit.operators.ranking import salted_lookup


def pixels_from_arrays(images: DataFrame, keys: Sequence[str], array: str, width: Column) -> DataFrame:
    """A1: one row per element of a row-major image array, with its row and column."""
    spread = images.select(*keys, width.alias("_w"), F.posexplode(array).alias("_pos", "value"))
    pos = F.col("_pos").cast("bigint")
    return spread.select(
        *keys,
        F.floor(pos / F.col("_w")).cast("int").alias("row"),
        F.pmod(pos, F.col("_w").cast("bigint")).cast("int").alias("col"),
        "value",
    )


def image_record(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mask pixels per image and the positive fraction inside it, NULL without labels."""
    labelled = F.count(F.when(F.col("label").isNotNull(), 1)) > 0
    positive = F.count_if(F.col("label") & F.col("in_fov"))
    fov = F.count_if(F.col("in_fov"))
    return pixels.groupBy(*keys).agg(
        fov.alias("fov_pixels"),
        F.when(labelled, positive).alias("positive_pixels"),
        F.when(labelled, S.ratio(positive, fov)).alias("vessel_fraction_in_fov"),
        labelled.alias("has_labels"),
    )


def channel(pixels: DataFrame, green: bool = True) -> DataFrame:
    """The green channel, or the gray value, with everything outside the mask at zero."""
    v = F.col("g") if green else S.luma(F.col("r"), F.col("g"), F.col("b"))
    return pixels.withColumn("v", F.when(F.col("in_fov"), v).otherwise(F.lit(0)).cast("int"))


def mask_stats(pixels: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean and population SD of ``value`` inside the mask; constant masks are marked."""
    return pixels.where("in_fov").groupBy(*keys).agg(
        F.avg(value).alias("_mean"),
        F.stddev_pop(value).alias("_sd"),
        (F.min(value) == F.max(value)).alias("_constant"),
    )


def standardize_in_mask(pixels: DataFrame, keys: Sequence[str], value: str, out: str = "z") -> DataFrame:
    """Subtract the mask's mean and divide by its population SD; zero outside the mask.

    A constant mask cannot be standardized: its rows keep NULL inside the mask, and
    ``constant_masks`` lists such images.
    """
    stats = mask_stats(pixels, keys, value)
    joined = salted_lookup(pixels, stats, keys, ["row", "col"])
    z = F.when(~F.col("_constant"), (F.col(value) - F.col("_mean")) / F.col("_sd"))
    return joined.withColumn(out, F.when(F.col("in_fov"), z).otherwise(F.lit(0.0))).drop(
        "_mean", "_sd", "_constant"
    )


def constant_masks(pixels: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return mask_stats(pixels, keys, value).where("_constant").select(*keys)


def preprocess(
    pixels: DataFrame,
    keys: Sequence[str],
    *,
    green_channel: bool = True,
    clahe: bool = True,
    clip_limit: float = 2.0,
    tile_grid: tuple[int, int] = (8, 8),
    scale_unit: bool = True,
    standardize: bool = True,
) -> DataFrame:
    """L2: channel, equalisation, scaling and standardisation, each of which can be switched off."""
    out = channel(pixels, green_channel)
    if clahe:
        out = equalize(out, keys, "v", clip_limit, tile_grid)
    x = F.col("v").cast("double")
    out = out.withColumn("x", x / F.lit(255.0) if scale_unit else x)
    if standardize:
        out = standardize_in_mask(out, keys, "x", "z").withColumn("x", F.col("z")).drop("z")
    return out.withColumn("x", F.when(F.col("in_fov"), F.col("x")).otherwise(F.lit(0.0)))
