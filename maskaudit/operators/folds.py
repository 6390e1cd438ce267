"""Seeded cross-validation folds over whole items."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from hashlib import md5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskaudit.functions import draws
from maskaudit.operators.ranking import keyed_rank


def check_fold_inputs(
    n_ids: int, n_distinct: int, n_known: int, spread: Sequence, n_folds: int, n_val: int
) -> None:
    """Raise for the sizes no fold plan exists for."""
    if n_distinct != n_ids:
        raise ValueError("ids contain duplicates")
    if len(set(spread)) != len(spread):
        raise ValueError("spread ids contain duplicates")
    if n_ids == 0 or n_folds < 2 or n_ids % n_folds != 0:
        raise ValueError(f"cannot split {n_ids} items into {n_folds} equal folds")
    if n_known != len(spread):
        raise ValueError(f"spread ids not among the items: {len(spread) - n_known} unknown")
    if len(spread) > n_folds:
        raise ValueError(f"cannot spread {len(spread)} items over {n_folds} folds")
    if n_val < 1 or n_ids // n_folds + n_val >= n_ids:
        raise ValueError(f"n_val={n_val} leaves no training items with {n_ids} items")


def spread_folds(n_spread: int, n_folds: int, seed: int) -> list[int]:
    """Return the distinct test folds of the first ``n_spread`` spread ids, in rank order."""

    def key(fold: int) -> tuple[int, int]:
        text = f"{seed}|fold|{fold}".encode()
        return int(md5(text).hexdigest()[: draws.DRAW_HEX_DIGITS], 16), fold

    return sorted(range(1, n_folds + 1), key=key)[:n_spread]


def test_folds(
    ids: DataFrame, id_col: str, spread: Collection, n_folds: int, n_val: int, seed: int
) -> DataFrame:
    """Give every id the one fold that tests it.

    Spread ids go to different folds; the others fill what each fold still needs, in hash order.
    The plan depends on the set of ids and the seed only. Sizes are checked with one aggregation
    before the plan is built; ``spread`` never exceeds ``n_folds`` ids.
    """
    spread = list(spread)
    known = F.count_if(F.col(id_col).isin(spread)) if spread else F.lit(0)
    n_ids, n_distinct, n_known = ids.agg(
        F.count("*"), F.count_distinct(id_col), known
    ).first()
    check_fold_inputs(n_ids, n_distinct, n_known, spread, n_folds, n_val)
    per_fold = n_ids // n_folds
    homes = spread_folds(len(spread), n_folds, seed)
    first_slot, offset = [], 0
    for fold in range(1, n_folds + 1):
        first_slot.append(offset)
        offset += per_fold - homes.count(fold)

    chosen = ids.select(id_col)
    is_spread = F.col(id_col).isin(spread) if spread else F.lit(False)
    purpose = F.when(is_spread, draws.draw(seed, "spread", F.col(id_col))).otherwise(
        draws.draw(seed, "other", F.col(id_col))
    )
    ranked = keyed_rank(
        chosen.withColumns({"_spread": is_spread, "_d": purpose}), ["_spread"], "_d", id_col, "_rank"
    )
    slots = F.array(*[F.lit(s).cast("bigint") for s in first_slot])
    filled = F.size(F.filter(slots, lambda s: s <= F.col("_rank")))
    if spread:
        home = F.element_at(F.array(*[F.lit(f) for f in homes]), (F.col("_rank") + 1).cast("int"))
        filled = F.when(F.col("_spread"), home).otherwise(filled)
    return ranked.select(id_col, filled.cast("int").alias("test_fold"))


def make_folds(
    ids: DataFrame, id_col: str, spread: Collection, n_folds: int, n_val: int, seed: int
) -> DataFrame:
    """K1, K2: one row (fold, id, role) per fold and id, with role test, val or train.

    Validation ids of a fold are its ``n_val`` first non-test ids by a hash of (fold, id).
    """
    tested = test_folds(ids, id_col, spread, n_folds, n_val, seed)
    all_folds = F.sequence(F.lit(1), F.lit(n_folds))
    pairs = tested.withColumn("fold", F.explode(all_folds)).withColumn(
        "_d", draws.draw(seed, "val", F.col("fold"), F.col(id_col))
    )
    rest = keyed_rank(pairs.where("fold <> test_fold"), ["fold"], "_d", id_col, "_rank")
    role = F.when(F.col("_rank") < n_val, F.lit("val")).otherwise(F.lit("train"))
    return rest.select("fold", id_col, role.alias("role")).unionByName(
        pairs.where("fold = test_fold").select("fold", id_col, F.lit("test").alias("role"))
    )


def fold_role_counts(folds: DataFrame) -> DataFrame:
    """K3: how many ids hold each role in each fold."""
    return folds.groupBy("fold", "role").agg(F.count("*").alias("n"))


def fold_rows_diff(stored: DataFrame, computed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that only one of two assignments holds."""
    a, b = stored.select(*columns), computed.select(*columns)
    return (
        a.exceptAll(b).withColumn("side", F.lit("stored only"))
        .unionByName(b.exceptAll(a).withColumn("side", F.lit("computed only")))
    )


def fold_signatures(assignments: DataFrame) -> DataFrame:
    """C4: one order-independent signature per run of its whole (fold, image, role) set.

    Row count plus the exact sums of two 60-bit pieces of each row's md5. A run's rows are never
    gathered, and equal sets give equal signatures; unequal sets agree with a chance of 2**-120.
    """
    text = F.concat_ws("|", F.col("fold").cast("string"), F.col("role"), F.col("image_id"))
    row = assignments.select("run_id", "fold", "image_id", "role").distinct().withColumn(
        "_h", F.md5(text)
    )

    def piece(start: int) -> Column:
        digits = F.substring("_h", start, draws.DRAW_HEX_DIGITS)
        return F.sum(F.conv(digits, 16, 10).cast("decimal(20,0)"))

    return row.groupBy("run_id").agg(
        F.count("*").alias("sig_rows"), piece(1).alias("sig_a"), piece(17).alias("sig_b")
    )
