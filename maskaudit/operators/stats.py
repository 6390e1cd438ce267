"""Summaries across items: spread, bootstrap intervals, subgroups."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskaudit.functions import draws
from maskaudit.operators.ranking import exact_quantiles, keyed_rank, null_safe_join

DRAWS = 128  # resamples that are drawn together at most
POSITIONS = 4096  # positions of one line of values
SIZES = 2  # group sizes whose ratio is less share their draws
CELLS = 1 << 23  # values that a task holds, about; a multiple of POSITIONS
COLUMNS = 1024  # groups that a task holds, about
DRAWN = 1 << 21  # draws that a task holds
LANES = 32  # parts of the resamples, each with a copy of the values


def long_metrics(items: DataFrame, keys: Sequence[str], id_col: str, metrics: Sequence[str]) -> DataFrame:
    """Turn metric columns into (metric, value) rows; missing values are left out per metric."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    # An unpivot names its rows anew wherever a plan reads them twice, which keeps Spark from reusing a shuffle of them.
    return items.select(*keys, id_col, F.explode(pairs).alias("_m")).select(
        *keys, id_col, F.col("_m.metric").alias("metric"), F.col("_m.value").alias("value")
    ).where("value IS NOT NULL")


def _shared(values: DataFrame) -> DataFrame:
    """Shuffle the values, one per item and metric.

    Every pass over the result then starts from this one exchange, which Spark reuses, and not from the pixels behind it.
    All columns are keys of it: a column that a pass does not read would otherwise be left out, and make an exchange of its own.
    """
    return values.where("value IS NOT NULL").repartition(*values.columns)


def summarize(values: DataFrame, groups: Sequence[str]) -> DataFrame:
    """N, mean, sample SD, median, min and max of ``value`` per group."""
    values = _shared(values)
    spread = values.groupBy(*groups).agg(
        F.count("*").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"),
        F.min("value").alias("minimum"),
        F.max("value").alias("maximum"),
    )
    median = exact_quantiles(values, groups, "value", {"median": 0.5})
    return null_safe_join(spread, median, [*groups])


def too_few(summary: DataFrame) -> DataFrame:
    """Groups whose SD is undefined; the report refuses them."""
    return summary.where("n < 2")


def _chunks(sizes: DataFrame) -> DataFrame:
    """Return (_g, n, class, chunk): groups of one class have similar sizes, those of one chunk fit into a task.

    Of a group with more than ``CELLS`` values, that many at a time count.
    """
    kind = F.floor(F.log(float(SIZES), F.col("n").cast("double")))
    placed = sizes.select("_g", "n", kind.alias("class"))
    held = F.sum(F.least(F.col("n"), F.lit(CELLS)))
    number = F.greatest(F.ceil(held / F.lit(CELLS)), F.ceil(F.count("*") / F.lit(COLUMNS)))
    return placed.join(placed.groupBy("class").agg(number.alias("_chunks")), "class").select(
        "_g", "n", "class", F.pmod(F.xxhash64("_g"), F.col("_chunks")).alias("chunk")
    )


def _resample_sums(placed: DataFrame, resamples: int, seed: int) -> DataFrame:
    """Return (_g, n, resample, total) of ``placed`` (_g, n, class, chunk, pos, value): the sums of resampled values.

    Position j of resample r draws by a hash of (seed, r, j). The values are what moves: every part of the resamples gets a
    copy of them and makes its draws where they are, once for all groups of a chunk. It takes them modulo each size and
    multiplies the counts (resample x position) by the values (position x group). Groups with more than ``CELLS`` values
    come in pieces; all draws are made for each of these, and those of other pieces are passed over.
    """
    lanes = min(LANES, resamples)
    cells, drawn_at_once = CELLS, DRAWN
    together, positions = DRAWS, POSITIONS

    def sums(table: pa.Table) -> pa.Table:
        lane, piece = table.column("lane")[0].as_py(), table.column("piece")[0].as_py()
        first, last = lane * resamples // lanes, (lane + 1) * resamples // lanes
        size, name, block = (table.column(c).to_pylist() for c in ("n", "_g", "block"))
        at = {}  # of a size: the rows of its matrix
        for n, g in zip(size, name):
            names = at.setdefault(n, {})
            names.setdefault(g, len(names))
        low = piece * cells
        matrices = {n: np.zeros((len(names), min(n - low, cells))) for n, names in at.items()}
        k = 0
        for chunk in table.column("line").chunks:
            ends, flat = chunk.offsets.to_numpy(), chunk.values.to_numpy(zero_copy_only=False)
            for a, b in zip(ends, ends[1:]):
                n, start = size[k], block[k] * positions - low
                matrices[n][at[n][name[k]], start : start + b - a] = flat[a:b]
                k += 1
        del table
        longest = max(at)
        step = max(1, min(together, drawn_at_once // longest))
        out = []
        for start in range(first, last, step):
            rows = range(start, min(start + step, last))
            drawn = draws.draw_table(seed, "bootstrap", rows, range(longest))
            for n, matrix in matrices.items():
                own = drawn[:, :n]
                own = (own - own // np.uint64(n) * np.uint64(n)).view(np.int64)
                counts = np.empty((len(rows), matrix.shape[1]))
                for r, line in enumerate(own):
                    if n > cells:
                        line = line[(line >= low) & (line < low + cells)] - low
                    counts[r] = np.bincount(line, minlength=matrix.shape[1])
                total = counts @ matrix.T
                out.append(pa.record_batch({
                    "_g": pa.array(list(at[n])).take(pa.array(np.tile(np.arange(len(matrix)), len(rows)))),
                    "n": np.full(total.size, n), "total": total.ravel(),
                    "resample": np.repeat(np.arange(rows.start, rows.stop, dtype=np.int32), len(matrix)),
                }).select(["_g", "n", "resample", "total"]))
        return pa.Table.from_batches(out)

    lines = placed.groupBy("_g", "n", "class", "chunk", F.floor(F.col("pos") / F.lit(POSITIONS)).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("_l")
    )
    key = ["class", "chunk", "piece", "lane"]
    moved = lines.select(
        "_g", "n", "class", "chunk", "block", F.floor(F.col("block") * F.lit(POSITIONS) / F.lit(CELLS)).alias("piece"),
        F.col("_l.value").alias("line"), F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"),
    )
    # Few rows of much work: a fixed number of partitions, as merged by their size they would be too few.
    partitions = 4 * max(LANES, int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return moved.repartition(partitions, *key).groupBy(*key).applyInArrow(
        sums, "_g string, n bigint, resample int, total double"
    )


def bootstrap_mean_ci(
    values: DataFrame, groups: Sequence[str], id_col: str, resamples: int, seed: int, level: float
) -> DataFrame:
    """Percentile bootstrap interval of the mean of ``value`` per group.

    Position ``j`` of resample ``r`` draws one of the group's ``n`` values by a hash of (seed, r, j)
    alone, so metrics with the same images are resampled with the same draws. The values are placed
    by a hash of their id, which needs no ordered pass over a group.

    A resample is a row of counts, how often it draws each position. Blocks of these rows are multiplied with the groups'
    values and the products summed, so the work is a matrix product, no draw becomes a row and none is shuffled.
    """
    if not 0 < level < 1:
        raise ValueError(f"level must lie in (0, 1), got {level}")
    if resamples < 1:
        raise ValueError(f"need at least one resample, got {resamples}")
    # A group's name as one text that is never NULL: joins on it put no filter between the values' one exchange and a pass.
    name = F.coalesce(F.to_json(F.struct(F.lit(0).alias("_"), *groups)), F.lit(""))
    values = _shared(values).withColumn("_g", name)
    keyed = values.select("_g", id_col, F.col("value").cast("double").alias("value")).withColumn(
        "_d", draws.draw(seed, "position", F.col(id_col))
    )
    sizes = values.groupBy(*groups, "_g").agg(F.count("*").alias("n"))
    placed = keyed_rank(keyed, ["_g"], "_d", id_col, "pos", _chunks(sizes)).select("_g", "n", "class", "chunk", "pos", "value")
    sums = _resample_sums(placed, resamples, seed)
    means = sums.groupBy("_g", "n", "resample").agg(F.sum("total").alias("total")).select(
        "_g", (F.col("total") / F.col("n")).alias("m")
    )
    tail = (1 - level) / 2
    # One value per resample: the exact percentile holds a fixed number of values per group.
    ends = means.groupBy("_g").agg(
        F.percentile("m", F.lit(tail)).alias("ci_low"),
        F.percentile("m", F.lit(1 - tail)).alias("ci_high"),
    )
    return sizes.join(ends, "_g").select(*groups, "ci_low", "ci_high")


def summary_with_ci(
    values: DataFrame, groups: Sequence[str], id_col: str, resamples: int, seed: int, level: float
) -> DataFrame:
    """Summary columns plus the bootstrap interval of the mean."""
    ci = bootstrap_mean_ci(values, groups, id_col, resamples, seed, level)
    return null_safe_join(summarize(values, groups), ci, [*groups])


def majority_accuracy(images: DataFrame, keys: Sequence[str], fraction: str) -> DataFrame:
    """Mean accuracy of predicting no positive anywhere."""
    return images.groupBy(*keys).agg(F.avg(F.lit(1.0) - F.col(fraction)).alias("majority_accuracy"))


def dataset_stats(images: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Labelled images, pixel-weighted positive fraction, and its range over images.

    Needs ``fov_pixels`` and ``positive_pixels`` per image; unlabelled images do not count.
    """
    fraction = F.col("positive_pixels").cast("double") / F.col("fov_pixels").cast("double")
    return images.where(F.col("positive_pixels").isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n_images"),
        (F.sum("positive_pixels").cast("double") / F.sum("fov_pixels").cast("double")).alias(
            "pooled_fraction"
        ),
        F.min(fraction).alias("min_fraction"),
        F.max(fraction).alias("max_fraction"),
    )


def subgroup_summary(values: DataFrame, groups: Sequence[str], flag: str) -> DataFrame:
    """Count, median, min and max of ``value`` for the flagged group and for the rest."""
    by = [*groups, flag]
    values = _shared(values)
    spread = values.groupBy(*by).agg(
        F.count("*").alias("n"), F.min("value").alias("minimum"), F.max("value").alias("maximum")
    )
    return null_safe_join(spread, exact_quantiles(values, by, "value", {"median": 0.5}), by)
