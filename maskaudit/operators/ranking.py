"""Exact ranks and running sums without a single-task window.

Three ways, all exact whatever the skew:

* ``keyed_rank`` orders by a uniform hash draw. The leading bits of the draw split every group
  into even buckets, so the window runs per (group, bucket) and only bucket totals are summed.
* ``running_counts`` orders by any columns. The rows are range partitioned on group and order
  together, so a group that holds a third of all rows spreads over a third of the partitions;
  the partition numbers are materialised once, and only per-partition totals are summed.
* ``exact_quantiles`` needs no order at all: histograms over ever lower bits of the values narrow
  the place of each wanted rank until one value is left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskaudit.functions.draws import DRAW_RANGE
from maskaudit.session import cut_lineage

RANK_BUCKETS = 4096
RADIX_SHIFTS = (42, 21, 0)  # a histogram reads the leading 22 bits of a value, the next ones 21 bits each


def keyed_rank(
    df: DataFrame, groups: Sequence[str], draw_col: str, id_col: str, name: str = "rank", facts: DataFrame | None = None
) -> DataFrame:
    """Add the 0-based rank by (draw, id) inside each group, as a BIGINT column.

    The other columns of ``facts``, a row per group, are added too; they come with the buckets and cost no join of their own.
    """
    width = DRAW_RANGE // RANK_BUCKETS
    # Never NULL: a filter for that would go down to the source, and the rows there would not be those of another pass.
    bucketed = df.withColumn("_bucket", F.coalesce(F.floor(F.col(draw_col) / F.lit(width)).cast("int"), F.lit(0)))
    sizes = bucketed.groupBy(*groups, "_bucket").agg(F.count("*").alias("_n"))
    # At most RANK_BUCKETS rows per group. Without groups, a constant key keeps the window keyed.
    before = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.select(
        *groups, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    if facts is not None:
        offsets = offsets.join(facts, [*groups])
    inside = Window.partitionBy(*groups, "_bucket").orderBy(draw_col, id_col)
    return (
        bucketed.join(offsets, [*groups, "_bucket"])
        .withColumn(name, (F.col("_offset") + F.row_number().over(inside) - 1).cast("bigint"))
        .drop("_bucket", "_offset")
    )


def running_counts(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[Column],
    sums: dict[str, Column] | None = None,
) -> DataFrame:
    """Add, per group, the sums over all earlier rows in ``order`` (``<name>_before``) and in total.

    ``order`` must be unique inside a group. Without ``sums`` the only sum is ``n``, the row count,
    so ``n_before`` is the 0-based rank and ``n_total`` the group size.
    """
    sums = sums or {"n": F.lit(1).cast("bigint")}
    staged = df
    for name, expr in sums.items():
        staged = staged.withColumn(f"_v_{name}", expr)
    spread = staged.repartitionByRange(*[F.col(g) for g in groups], *order).withColumn(
        "_part", F.spark_partition_id()
    )
    spread = cut_lineage(spread)
    totals = spread.groupBy(*groups, "_part").agg(
        *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums]
    )
    group_key = [*groups] or [F.lit(0)]
    whole = Window.partitionBy(*group_key)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *groups,
        "_part",
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_t_{n}").over(whole).alias(f"{n}_total") for n in sums],
    )
    inside = (
        Window.partitionBy(*groups, "_part")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = null_safe_join(spread, offsets, [*groups, "_part"])
    for name in sums:
        joined = joined.withColumn(
            f"{name}_before",
            F.col(f"_o_{name}") + F.coalesce(F.sum(f"_v_{name}").over(inside), F.lit(0)),
        )
    return joined.drop("_part", *[f"_v_{n}" for n in sums], *[f"_o_{n}" for n in sums])


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be NULL, keeping the left key columns."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    condition = F.lit(True)
    for i, k in enumerate(keys):
        same = left[k].eqNullSafe(renamed[f"_r_{k}"])
        condition = same if i == 0 else condition & same
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def with_rank(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column], name: str
) -> DataFrame:
    """Add the 1-based rank inside each group as BIGINT."""
    ranked = running_counts(df, groups, order)
    return ranked.withColumn(name, (F.col("n_before") + 1).cast("bigint")).drop(
        "n_before", "n_total"
    )


def order_key(value: Column) -> Column:
    """Map a DOUBLE to the BIGINT of the same order: its sign, exponent and fraction bits.

    Equal values have equal keys, -0.0 and 0.0 included; NaN is the largest, as in Spark's own order.
    """
    size = F.abs(value)
    least = 2.0**-1022  # below it a value is a multiple of 2**-1074 without an exponent of its own
    guess = F.floor(F.log2(size))
    exponent = (
        guess
        + F.when(size >= F.pow(F.lit(2.0), guess + 1), 1).otherwise(0)
        - F.when(size < F.pow(F.lit(2.0), guess), 1).otherwise(0)
    )
    fraction = (size * F.pow(F.lit(2.0), -exponent) - F.lit(1.0)) * F.lit(2.0**52)
    normal = F.shiftleft((exponent + 1023).cast("bigint"), 52) + fraction.cast("bigint")
    small = (size * F.lit(2.0**1000) * F.lit(2.0**74)).cast("bigint")
    infinite = F.lit(2047 << 52)
    bits = F.when(size == float("inf"), infinite).when(size < least, small).otherwise(normal)
    return F.when(F.isnan(value), infinite + 1).when(value < 0, -bits).otherwise(bits)


def exact_quantiles(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    wanted: dict[str, float],
    method: str = "linear",
) -> DataFrame:
    """Return exact quantiles per group, one column per entry of ``wanted``, as DOUBLE.

    ``linear`` interpolates between the two neighbouring ranks, ``inverted_cdf`` returns an
    observed value. NULL values are left out. Equal values are counted first, so ties cost nothing.

    Ranks are found by radix selection: a histogram over the leading bits of the values says in which of its bins a rank
    lies, the next one counts only that bin's values by the following bits, and in the third a bin is one value. All
    histograms read the same shuffled counts; none has more than 2**22 bins per group and rank, however many values there
    are, and no group's values are ever sorted or ranked.
    """
    if method not in ("linear", "inverted_cdf"):
        raise ValueError(f"unknown quantile method {method!r}")
    for name, q in wanted.items():
        if not 0 <= q <= 1:
            raise ValueError(f"quantile {name} must lie in [0, 1], got {q}")
    counts = (
        df.select(*groups, F.col(value).cast("double").alias("_v"))
        .where(F.col("_v").isNotNull())
        .groupBy(*groups, "_v")
        .agg(F.count("*").alias("_c"))
        .withColumn("_k", order_key(F.col("_v")))
    )
    total = F.col("_total")
    steps: dict[str, tuple[Column, Column]] = {}
    for name, q in wanted.items():
        if method == "inverted_cdf":
            rank = F.greatest(F.ceil(total * F.lit(q)) - 1, F.lit(0))
            steps[name] = (rank, rank)
        else:
            h = (total - 1).cast("double") * F.lit(q)
            steps[name] = (F.floor(h), F.ceil(h))
    ranks = F.array_distinct(F.array(*[r.cast("bigint") for pair in steps.values() for r in pair]))

    def summed(bins: DataFrame, by: Sequence[str]) -> DataFrame:
        """Add the counts of all bins up to each one (``_upto``) and of all (``_all``)."""
        whole = Window.partitionBy(*([F.col(g) for g in by] or [F.lit(0)]))
        upto = whole.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
        return bins.withColumn("_upto", F.sum("_c").over(upto)).withColumn("_all", F.sum("_c").over(whole))

    before = F.col("_upto") - F.col("_c")
    bins = counts.groupBy(*groups, F.shiftright("_k", RADIX_SHIFTS[0]).alias("_bin")).agg(F.sum("_c").alias("_c"))
    here = F.filter(ranks, lambda r: (before <= r) & (r < F.col("_upto")))
    # One row per wanted rank: the bin it lies in and its rank there.
    found = (
        summed(bins, groups).withColumn("_total", F.col("_all")).withColumn("_rank", F.explode(here))
        .select(*groups, "_total", "_rank", "_bin", (F.col("_rank") - before).alias("_rest"))
    )
    for above, shift in zip(RADIX_SHIFTS, RADIX_SHIFTS[1:]):
        inside = null_safe_join(counts.withColumn("_bin", F.shiftright("_k", above)), found, [*groups, "_bin"])
        bins = inside.groupBy(*groups, "_total", "_rank", "_rest", F.shiftright("_k", shift).alias("_bin")).agg(
            F.sum("_c").alias("_c"), F.max("_v").alias("_v")
        )
        found = summed(bins, [*groups, "_rank"]).where((before <= F.col("_rest")) & (F.col("_rest") < F.col("_upto"))).select(
            *groups, "_total", "_rank", "_bin", (F.col("_rest") - before).alias("_rest"), "_v"
        )
        if shift > 0:
            found = found.drop("_v")

    def at(rank: Column) -> Column:
        return F.max(F.when(F.col("_rank") == rank, F.col("_v")))

    parts: list[Column] = []
    for name, q in wanted.items():
        low, high = steps[name]
        if method == "inverted_cdf":
            parts.append(at(low).alias(name))
            continue
        h = (total - 1).cast("double") * F.lit(q)
        part = F.max(h - F.floor(h).cast("double"))
        parts.append((at(low) + (at(high) - at(low)) * part).alias(name))
    return found.groupBy(*groups).agg(*parts)


def salted_lookup(
    big: DataFrame, small: DataFrame, on: Sequence[str], spread: Sequence[str], salts: int = 16
) -> DataFrame:
    """Attach one ``small`` row per key to ``big``, splitting every key over ``salts`` tasks.

    For per-item statistics joined back to pixels: an item that holds a third of all pixels is
    then read by many tasks. ``small`` is copied ``salts`` times. Neither side is broadcast: Spark does not count what an
    explode adds, and has taken all pixels for the smaller one.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.hint("merge").join(right, [*on, "_salt"]).drop("_salt")
