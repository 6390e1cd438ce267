"""Training patches: sampled centres, keyed augmentation, crops and batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskaudit.functions import draws
from maskaudit.operators.ranking import keyed_rank

N_ROTATIONS = 4
BAND = 1024  # numbers of mask pixels that are looked up together


def row_offsets(pixels: DataFrame, image: str) -> DataFrame:
    """Mask pixels per image row (``_n``) and in all rows above it (``_offset``)."""
    per_row = pixels.where("in_fov").groupBy(image, "row").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(image).orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return per_row.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def sample_centers(pixels: DataFrame, image: str, n: int, seed: int) -> DataFrame:
    """K4: draw ``n`` centres: an image uniformly, then one of its mask pixels uniformly.

    Mask pixels are numbered in row-major order, and a drawn number is looked up among the rows' offsets by the band of
    ``BAND`` numbers it lies in. Only the rows that were drawn are then read for their columns; no other pixel moves.
    An image without mask pixels cannot be drawn from; ``metrics.empty_masks`` lists those.
    """
    if n < 1:
        raise ValueError(f"need at least one center, got n={n}")
    rows = row_offsets(pixels, image)
    sizes = rows.groupBy(image).agg(F.sum("_n").alias("_fov"))
    numbered = keyed_rank(
        sizes.withColumn("_d", draws.draw(seed, "image order", F.col(image))), [], "_d", image,
        "_index",
    ).select(image, "_fov", "_index")
    n_images = sizes.agg(F.count("*")).scalar()
    drawn = pixels.sparkSession.range(n).select(
        F.col("id").alias("patch_id"),
        draws.draw_int(seed, "image", n_images, F.col("id")).alias("_index"),
    )
    picked = drawn.join(numbered, "_index").select(
        "patch_id",
        image,
        draws.draw_int(seed, "pixel", F.col("_fov"), F.col("patch_id")).alias("pick"),
    )

    def band(number: Column) -> Column:
        return F.floor(number / F.lit(BAND))

    bands = rows.withColumn("_band", F.explode(F.sequence(band(F.col("_offset")), band(F.col("_offset") + F.col("_n") - 1))))
    here = (F.col("pick") >= F.col("_offset")) & (F.col("pick") < F.col("_offset") + F.col("_n"))
    found = (
        picked.withColumn("_band", band(F.col("pick"))).join(bands, [image, "_band"]).where(here)
        .select("patch_id", image, "row", (F.col("pick") - F.col("_offset")).cast("int").alias("_place"))
    )
    lines = (
        pixels.where("in_fov").select(image, "row", "col")
        .join(found.select(image, "row").distinct(), [image, "row"], "left_semi")
        .groupBy(image, "row").agg(F.sort_array(F.collect_list("col")).alias("_cols"))
    )
    return found.join(lines, [image, "row"]).select("patch_id", image, "row", F.get("_cols", F.col("_place")).alias("col"))


def sample_augmentation(
    patches: DataFrame,
    seed: int,
    *,
    flip_probability: float = 0.5,
    rot90: bool = True,
    brightness_delta: float = 0.1,
    contrast_range: tuple[float, float] = (0.9, 1.1),
) -> DataFrame:
    """K5: add augmentation parameters per patch.

    Every parameter has a draw of its own, so switching a step off never changes the others.
    """
    patch = F.col("patch_id")
    low, high = contrast_range

    def uniform(purpose: str, a: float, b: float) -> Column:
        return F.lit(a) + draws.draw_unit(seed, purpose, patch) * F.lit(b - a)

    return patches.withColumns(
        {
            "flip_rows": draws.draw_unit(seed, "flip_rows", patch) < F.lit(flip_probability),
            "flip_cols": draws.draw_unit(seed, "flip_cols", patch) < F.lit(flip_probability),
            "rotations": (
                draws.draw_int(seed, "rotations", N_ROTATIONS, patch) * F.lit(int(rot90))
            ).cast("int"),
            "brightness": uniform("brightness", -brightness_delta, brightness_delta),
            "contrast": uniform("contrast", low, high),
        }
    )


def crop(
    centers: DataFrame, pixels: DataFrame, image: str, value: str, size: int,
    carry: Sequence[str] = (),
) -> DataFrame:
    """The ``size`` x ``size`` pixels around every centre, 0 beyond the image.

    An equi join on pixel coordinates: no theta join, and no key heavier than the patches on it.
    """
    if size < 1:
        raise ValueError(f"size must be positive, got {size}")
    half = size // 2
    steps = F.sequence(F.lit(0), F.lit(size - 1))
    cells = (
        centers.withColumn("pr", F.explode(steps))
        .withColumn("pc", F.explode(steps))
        .select(
            "patch_id", image, *carry, "pr", "pc",
            (F.col("row") - half + F.col("pr")).alias("row"),
            (F.col("col") - half + F.col("pc")).alias("col"),
        )
    )
    source = pixels.select(
        image, "row", "col",
        F.col(value).cast("double").alias("x"),
        F.coalesce(F.col("label"), F.lit(False)).cast("double").alias("y"),
        F.col("in_fov").cast("double").alias("w"),
    )
    return cells.join(source, [image, "row", "col"], "left").select(
        "patch_id", image, *carry, "pr", "pc",
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("x", "y", "w")],
    )


def augment_geometry(patches: DataFrame, size: int) -> DataFrame:
    """K7: flip and turn every patch by moving coordinates; image, label and mask move together."""
    last = size - 1
    r = F.when(F.col("flip_rows"), last - F.col("pr")).otherwise(F.col("pr"))
    c = F.when(F.col("flip_cols"), last - F.col("pc")).otherwise(F.col("pc"))
    moved = patches.withColumns({"_r": r, "_c": c})
    k = F.col("rotations")
    # One counter-clockwise quarter turn sends (r, c) to (last - c, r).
    row = (
        F.when(k == 1, last - F.col("_c"))
        .when(k == 2, last - F.col("_r"))
        .when(k == 3, F.col("_c"))
        .otherwise(F.col("_r"))
    )
    col = (
        F.when(k == 1, F.col("_r"))
        .when(k == 2, last - F.col("_c"))
        .when(k == 3, last - F.col("_r"))
        .otherwise(F.col("_c"))
    )
    return moved.withColumns({"pr": row.cast("int"), "pc": col.cast("int")}).drop("_r", "_c")


def jitter(patches: DataFrame) -> DataFrame:
    """K8: scale contrast about the mask mean and shift brightness, inside the mask only.

    The window holds one patch.
    """
    patch = Window.partitionBy("patch_id")
    mean = F.sum(F.col("x") * F.col("w")).over(patch) / F.greatest(
        F.sum("w").over(patch), F.lit(1.0)
    )
    x, contrast = F.col("x"), F.col("contrast")
    jittered = (x * contrast + (F.lit(1.0) - contrast) * F.col("_mean") + F.col("brightness")) * F.col("w")
    return patches.withColumn("_mean", mean).withColumn("x", jittered).drop("_mean")


def batches(patches: DataFrame, batch_size: int) -> DataFrame:
    """K9: one row per patch with its batch, place in the batch, and row-major arrays."""
    if batch_size < 1:
        raise ValueError(f"batch_size must be positive, got {batch_size}")

    def packed(value: str) -> Column:
        cells = F.array_sort(F.collect_list(F.struct("pr", "pc", F.col(value).alias("v"))))
        return F.transform(cells, lambda s: s["v"]).alias(value)

    grouped = patches.groupBy("patch_id").agg(packed("x"), packed("y"), packed("w"))
    return grouped.select(
        F.floor(F.col("patch_id") / F.lit(batch_size)).cast("bigint").alias("batch_id"),
        F.pmod(F.col("patch_id"), F.lit(batch_size)).cast("int").alias("slot"),
        "patch_id", "x", "y", "w",
    )


def patch_dataset(
    pixels: DataFrame, image: str, value: str, *, size: int, n: int, batch_size: int, seed: int,
    **augmentation,
) -> DataFrame:
    """K4-K9 in one plan: sample, crop, augment and batch."""
    parameters = ("flip_rows", "flip_cols", "rotations", "brightness", "contrast")
    centers = sample_augmentation(sample_centers(pixels, image, n, seed), seed, **augmentation)
    cropped = crop(centers, pixels, image, value, size, parameters)
    return batches(jitter(augment_geometry(cropped, size)), batch_size)
