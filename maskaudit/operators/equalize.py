"""Tiled contrast-limited histogram equalisation of 8-bit images, with dense tables per tile.

A tile is one row: its histogram and its lookup table are arrays of 256 numbers, however many pixels it has. Pixels are
counted once (with partial aggregation) and shuffled once, by image and block of ``BLOCK`` x ``BLOCK`` positions, to meet
first the image's shape and then its tables. A block is the unit of work, so one large image spreads over many tasks, and
the tables sent to it do not grow with the image: a tile grid has a fixed number of tiles.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = 256
BLOCK = 256
CHUNK = 1024  # tiles of one matrix


def image_shape(pixels: DataFrame, keys: Sequence[str], tile_grid: tuple[int, int]) -> DataFrame:
    """Height and width per image and the tile size after padding to a whole number of tiles."""
    ty, tx = tile_grid
    shape = pixels.groupBy(*keys).agg(
        (F.max("row") + 1).alias("_h"), (F.max("col") + 1).alias("_w")
    )
    even = (F.col("_h") % ty == 0) & (F.col("_w") % tx == 0)
    padded_h = F.when(even, F.col("_h")).otherwise(F.col("_h") + ty - F.col("_h") % ty)
    padded_w = F.when(even, F.col("_w")).otherwise(F.col("_w") + tx - F.col("_w") % tx)
    return shape.select(
        *keys,
        "_h",
        "_w",
        F.floor(padded_h / F.lit(ty)).cast("int").alias("_th"),
        F.floor(padded_w / F.lit(tx)).cast("int").alias("_tw"),
    )


SHAPE = ("_h", "_w", "_th", "_tw")


def _block(position: str) -> Column:
    return F.floor(F.col(position) / F.lit(BLOCK)).cast("int")


def _per_block(images: DataFrame) -> DataFrame:
    """Copy a row per image to every block of it."""
    out = images
    for name, size in (("_br", "_h"), ("_bc", "_w")):
        last = F.floor((F.col(size) - 1) / F.lit(BLOCK)).cast("int")
        out = out.withColumn(name, F.explode(F.sequence(F.lit(0), last)))
    return out


def in_blocks(pixels: DataFrame, shape: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach its image's shape to every pixel, split by block."""
    marked = pixels.withColumn("_br", _block("row")).withColumn("_bc", _block("col"))
    return marked.join(_per_block(shape), [*keys, "_br", "_bc"])


def _with_mirror(position: Column, size: Column, padded: Column) -> Column:
    # Padding mirrors the image about its last row or column, without repeating it.
    mirrored = 2 * (size - 1) - position
    inside = (mirrored >= size) & (mirrored < padded)
    return F.when(inside, F.array(position, mirrored)).otherwise(F.array(position))


def tile_tables(
    placed: DataFrame, shape: DataFrame, keys: Sequence[str], value: str, clip_limit: float, tile_grid: tuple[int, int]
) -> DataFrame:
    """Return per tile ``hist``, ``clipped`` and the lookup table ``lut``, arrays of 256 numbers; no tile is missing.

    ``placed`` are pixels with the columns of ``shape``. Every value is counted in every tile, mirrored padding
    included. The counts of a tile, at most one per level, become dense rows of a matrix, on which clipping and running
    sums are whole-matrix operations.
    """
    ty, tx = tile_grid
    spread = (
        placed.select(
            *keys, value, *SHAPE, "col",
            F.explode(_with_mirror(F.col("row"), F.col("_h"), F.col("_th") * ty)).alias("_r"),
        )
        .select(
            *keys, value, *SHAPE, "_r",
            F.explode(_with_mirror(F.col("col"), F.col("_w"), F.col("_tw") * tx)).alias("_c"),
        )
    )
    counted = spread.groupBy(
        *keys,
        *SHAPE,
        F.floor(F.col("_r") / F.col("_th")).cast("int").alias("tile_row"),
        F.floor(F.col("_c") / F.col("_tw")).cast("int").alias("tile_col"),
        F.col(value).cast("int").alias("level"),
    ).agg(F.count("*").alias("n"))
    # A tile beyond all pixels has no counted level; a count of 0 only makes its row.
    every = (
        shape.withColumn("tile_row", F.explode(F.sequence(F.lit(0), F.lit(ty - 1))))
        .withColumn("tile_col", F.explode(F.sequence(F.lit(0), F.lit(tx - 1))))
        .withColumn("level", F.lit(0))
        .withColumn("n", F.lit(0).cast("bigint"))
    )
    # At most tiles x 257 rows per image: one shuffle by image serves the tiles and the tables per image. Its partitions
    # are few rows of much work, so they are not to be merged by their size.
    partitions = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = counted.unionByName(every.select(*counted.columns)).repartition(partitions, *keys)
    tiles = rows.groupBy(*keys, *SHAPE, "tile_row", "tile_col").agg(
        F.collect_list("level").alias("level"), F.collect_list("n").alias("n")
    )
    names = [*keys, *SHAPE, "tile_row", "tile_col"]

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(begin, CHUNK)
                levels, counts = batch.column("level"), batch.column("n")
                owner = np.repeat(np.arange(batch.num_rows), levels.value_lengths().to_numpy())
                hist = np.zeros((batch.num_rows, LEVELS), dtype=np.int64)
                np.add.at(hist, (owner, levels.flatten().to_numpy()), counts.flatten().to_numpy())
                area = batch.column("_th").to_numpy().astype(np.int64) * batch.column("_tw").to_numpy()
                clipped = _clip(hist, area, clip_limit)
                lut = _lookup(clipped, area)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in names), *(_lists(x) for x in (hist, clipped, lut))],
                    [*names, "hist", "clipped", "lut"],
                )

    kept = ", ".join(f"`{c}` {tiles.schema[c].dataType.simpleString()}" for c in names)
    return tiles.mapInArrow(tables, f"{kept}, hist array<bigint>, clipped array<bigint>, lut array<int>")


def _lists(rows: np.ndarray) -> pa.ListArray:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * LEVELS
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))


def _clip(hist: np.ndarray, area: np.ndarray, clip_limit: float) -> np.ndarray:
    """Clip the counts of each row and spread what was cut off: evenly, and the rest to every step-th level until used up."""
    if clip_limit <= 0:
        return hist
    most = np.maximum(np.floor(clip_limit * area.astype(np.float64) / LEVELS), 1).astype(np.int64)[:, None]
    excess = np.maximum(hist - most, 0).sum(axis=1, keepdims=True)
    share, rest = excess // LEVELS, excess % LEVELS
    step = np.maximum(LEVELS // np.maximum(rest, 1), 1)
    level = np.arange(LEVELS)
    return np.minimum(hist, most) + share + ((level % step == 0) & (level // step < rest))


def _lookup(clipped: np.ndarray, area: np.ndarray) -> np.ndarray:
    """The running sums of each row, scaled to 0 to 255 in single precision and rounded half to even."""
    scale = np.float32(LEVELS - 1) / area.astype(np.float32)
    raw = np.cumsum(clipped, axis=1).astype(np.float32) * scale[:, None]
    return np.clip(np.rint(raw.astype(np.float64)), 0, LEVELS - 1).astype(np.int32)


def lut_rows(luts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per tile and level: ``clipped`` and ``lut``."""
    both = F.posexplode(F.arrays_zip("clipped", "lut")).alias("level", "_t")
    return luts.select(*keys, "tile_row", "tile_col", both).select(
        *keys, "tile_row", "tile_col", "level", F.col("_t.clipped").alias("clipped"), F.col("_t.lut").alias("lut")
    )


def equalize(
    pixels: DataFrame,
    keys: Sequence[str],
    value: str,
    clip_limit: float = 2.0,
    tile_grid: tuple[int, int] = (8, 8),
) -> DataFrame:
    """L1: replace ``value`` (0 to 255) by its equalised level, blended between the four nearest tiles."""
    ty, tx = tile_grid
    shape = image_shape(pixels, keys, tile_grid)
    placed = in_blocks(pixels, shape, keys)
    luts = tile_tables(placed, shape, keys, value, clip_limit, tile_grid)
    tables = luts.groupBy(*keys, *SHAPE).agg(
        F.sort_array(F.collect_list(F.struct("tile_row", "tile_col", "lut"))).alias("_t")
    )
    tables = _per_block(tables.withColumn("_luts", F.col("_t.lut"))).select(*keys, "_br", "_bc", "_luts")

    one, half = F.lit(1.0).cast("float"), F.lit(0.5).cast("float")

    def place(position: str, size: str) -> Column:
        inverse = (one / F.col(size).cast("float")).cast("float")
        return (F.col(position).cast("float") * inverse - half).cast("float")

    # A pixel lies between tile rows _y and _y + 1, clamped at the image border (columns alike).
    located = (
        placed.withColumn("_fy", place("row", "_th"))
        .withColumn("_fx", place("col", "_tw"))
        .withColumn("_y", F.floor("_fy").cast("int"))
        .withColumn("_x", F.floor("_fx").cast("int"))
    )

    def corner(down: int, right: int) -> Column:
        y = F.least(F.greatest(F.col("_y") + down, F.lit(0)), F.lit(ty - 1))
        x = F.least(F.greatest(F.col("_x") + right, F.lit(0)), F.lit(tx - 1))
        return F.get(F.get("_luts", y * tx + x), F.col(value)).cast("float")

    ya = (F.col("_fy") - F.floor("_fy").cast("float")).cast("float")
    xa = (F.col("_fx") - F.floor("_fx").cast("float")).cast("float")
    top = (corner(0, 0) * (one - xa) + corner(0, 1) * xa).cast("float")
    low = (corner(1, 0) * (one - xa) + corner(1, 1) * xa).cast("float")
    mixed = (top * (one - ya) + low * ya).cast("float")
    level = F.bround(mixed.cast("double"), 0).cast("int")
    return (
        located.join(tables, [*keys, "_br", "_bc"])
        .withColumn(value, F.least(F.greatest(level, F.lit(0)), F.lit(255)))
        .select(*pixels.columns)
    )
