"""Sliding windows over whole images: cut, score with a pluggable model, and stitch."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskaudit.operators.ranking import salted_lookup

Scorer = Callable[[np.ndarray], np.ndarray]


def last_step(length: Column, window: int, stride: int) -> Column:
    """Index of the last window start, so that the last window reaches the edge."""
    if window < 1 or stride < 1:
        raise ValueError(f"window and stride must be positive, got {window} and {stride}")
    return F.greatest(F.ceil((length - window) / F.lit(float(stride))), F.lit(0)).cast("bigint")


def window_starts(lengths: DataFrame, length: str, window: int, stride: int) -> DataFrame:
    """One row per window start ``i * stride``."""
    steps = F.sequence(F.lit(0).cast("bigint"), last_step(F.col(length), window, stride))
    return lengths.withColumn("_i", F.explode(steps)).withColumn(
        "start", F.col("_i") * F.lit(stride)
    ).drop("_i")


def tile_windows(
    pixels: DataFrame, keys: Sequence[str], value: str, window: int, stride: int
) -> DataFrame:
    """Copy each pixel to every window that covers it, at most ``(window / stride)^2`` times."""
    shape = pixels.groupBy(*keys).agg(
        (F.max("row") + 1).alias("_h"), (F.max("col") + 1).alias("_w")
    )

    def covering(position: str, size: str) -> Column:
        p = F.col(position).cast("bigint")
        first = F.greatest(F.ceil((p - window + 1) / F.lit(float(stride))), F.lit(0)).cast("bigint")
        last = F.least(
            F.floor(p / F.lit(float(stride))).cast("bigint"),
            last_step(F.col(size), window, stride),
        )
        return F.sequence(first, last)

    return (
        salted_lookup(pixels.select(*keys, "row", "col", value), shape, keys, ["row", "col"])
        .withColumn("wr", F.explode(covering("row", "_h")))
        .withColumn("wc", F.explode(covering("col", "_w")))
        .select(
            *keys,
            "wr",
            "wc",
            (F.col("row") - F.col("wr") * stride).cast("int").alias("r"),
            (F.col("col") - F.col("wc") * stride).cast("int").alias("c"),
            value,
        )
    )


def _packed(tiles: DataFrame, keys: Sequence[str], value: str, window: int) -> DataFrame:
    """One row per window: the places of its pixels in it and their values, in any order."""
    place = (F.col("r") * window + F.col("c")).cast("int")
    return tiles.groupBy(*keys, "wr", "wc").agg(
        F.collect_list(place).alias("_k"),
        F.collect_list(F.coalesce(F.col(value).cast("float"), F.lit(0.0).cast("float"))).alias("_v"),
    )


def _dense(batch: pa.RecordBatch, window: int) -> np.ndarray:
    """The windows of a batch as rows of ``window * window`` FLOATs, 0 where padded."""
    places = batch.column("_k")
    out = np.zeros((batch.num_rows, window * window), dtype=np.float32)
    owner = np.repeat(np.arange(batch.num_rows), places.value_lengths().to_numpy())
    out[owner, places.flatten().to_numpy()] = batch.column("_v").flatten().to_numpy()
    return out


def _over_windows(packed: DataFrame, keys: Sequence[str], window: int, name: str, make: Callable[[], Callable]) -> DataFrame:
    """Add to each window's keys the array that ``make()`` makes of its dense values."""
    names = [*keys, "wr", "wc"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = make()
        for batch in batches:
            values = use(_dense(batch, window))
            offsets = np.arange(len(values) + 1, dtype=np.int32) * (window * window)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values).ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), lists], [*names, name])

    kept = ", ".join(f"`{c}` {packed.schema[c].dataType.simpleString()}" for c in names)
    return packed.mapInArrow(run, f"{kept}, {name} array<float>")


def window_arrays(tiles: DataFrame, keys: Sequence[str], value: str, window: int) -> DataFrame:
    """Pack each window as a row-major FLOAT array of ``window * window`` values, 0 where padded."""
    return _over_windows(_packed(tiles, keys, value, window), keys, window, "x", lambda: lambda values: values)


def _checked(scorer: Scorer, stacked: np.ndarray) -> np.ndarray:
    out = np.asarray(scorer(stacked), dtype=np.float32)
    if out.shape != stacked.shape:
        raise ValueError(f"scorer returned shape {out.shape} for windows {stacked.shape}")
    return out


def score_windows(windows: DataFrame, window: int, make_scorer: Callable[[], Scorer]) -> DataFrame:
    """Add ``score``, the scorer's output for each window.

    ``make_scorer`` runs once per Python worker and returns a function from a
    (batch, window, window, 1) float32 array to scores of the same shape, which is checked. Batch
    size follows ``spark.sql.execution.arrow.maxRecordsPerBatch``.
    """

    @F.pandas_udf("array<float>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = make_scorer()
        for x in batches:
            if len(x) == 0:
                yield pd.Series([], dtype=object)
                continue
            stacked = np.stack(x.to_list()).astype(np.float32).reshape(-1, window, window, 1)
            out = _checked(scorer, stacked)
            yield pd.Series(list(out.reshape(len(x), window * window)))

    return windows.withColumn("score", score("x"))


def stitch_windows(
    scored: DataFrame, pixels: DataFrame, keys: Sequence[str], window: int, stride: int
) -> DataFrame:
    """Mean score over the windows covering a pixel, 0 outside the mask."""
    cells = scored.select(*keys, "wr", "wc", F.posexplode("score").alias("_k", "_s")).select(
        *keys,
        (F.col("wr") * stride + F.floor(F.col("_k") / F.lit(window))).cast("int").alias("row"),
        (F.col("wc") * stride + F.col("_k") % window).cast("int").alias("col"),
        "_s",
    )
    mean = cells.groupBy(*keys, "row", "col").agg(F.avg(F.col("_s").cast("double")).alias("_m"))
    out = F.when(F.col("in_fov"), F.col("_m")).otherwise(F.lit(0.0)).cast("float")
    return (
        pixels.select(*keys, "row", "col", "in_fov")
        .join(mean, [*keys, "row", "col"])
        .select(*keys, "row", "col", out.alias("prob"))
    )


def predict_images(
    pixels: DataFrame,
    keys: Sequence[str],
    value: str,
    window: int,
    stride: int,
    make_scorer: Callable[[], Scorer],
) -> DataFrame:
    """Cut into windows, score, stitch and mask.

    A window goes to Python once, as the places and values of its pixels, and comes back as scores.
    """

    def scoring() -> Callable[[np.ndarray], np.ndarray]:
        scorer = make_scorer()
        return lambda values: _checked(scorer, values.reshape(-1, window, window, 1)) if len(values) else values

    packed = _packed(tile_windows(pixels, keys, value, window, stride), keys, value, window)
    return stitch_windows(_over_windows(packed, keys, window, "score", scoring), pixels, keys, window, stride)
