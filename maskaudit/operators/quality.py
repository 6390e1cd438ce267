"""Constraints as data-quality rules: one pass per table, one row per violation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskaudit.session import spread

MOST_RULES = 62  # bits of one mask


def broken_mask(rules: Sequence[Column]) -> Column:
    """One BIGINT per row, with a bit set for every rule the row breaks.

    A rule states what must hold; like a CHECK constraint it passes when it is NULL.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules do not fit into one mask of {MOST_RULES} bits")
    mask = F.lit(0).cast("bigint")
    for bit, rule in enumerate(rules):
        mask = mask + F.when(~rule, F.lit(1 << bit).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return mask


def violations(df: DataFrame, keys: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """Return (keys, rule) for every rule a row breaks, in one scan; rows that break none cost one number.

    A filter before the explode, or one that Spark infers from it, would be moved below the mask and work it out once more,
    bit by bit; so rows that break none are left out afterwards.
    """
    names = list(rules)
    set_bits = [
        F.when(F.col("_broken").bitwiseAND(F.lit(1 << bit).cast("bigint")) != 0, F.lit(name)) for bit, name in enumerate(names)
    ]
    return (
        df.select(*keys, broken_mask([rules[n] for n in names]).alias("_broken"))
        .select(*keys, F.explode_outer(F.array_compact(F.array(*set_bits))).alias("rule"))
        .where("rule IS NOT NULL")
    )


def enum_rules(domains: Mapping[str, Sequence]) -> dict[str, Column]:
    """Q1: the column holds one of the listed values."""
    return {f"{c}_enum": F.col(c).isin(list(v)) for c, v in domains.items()}


def unit_rules(columns: Sequence[str]) -> dict[str, Column]:
    """Q2: the column lies in [0, 1]."""
    return {f"{c}_unit": F.col(c).between(0.0, 1.0) for c in columns}


def minimum_rules(minima: Mapping[str, float]) -> dict[str, Column]:
    """Q2: the column is at least the given value."""
    return {f"{c}_min": F.col(c) >= F.lit(m) for c, m in minima.items()}


def not_null_rules(columns: Sequence[str]) -> dict[str, Column]:
    return {f"{c}_not_null": F.col(c).isNotNull() for c in columns}


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Q9: primary keys held by more than one row."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def dangling(
    child: DataFrame, parent: DataFrame, child_keys: Sequence[str], parent_keys: Sequence[str]
) -> DataFrame:
    """Distinct child keys without a parent; a NULL in the key refers to nothing."""
    present = F.lit(True)
    for k in child_keys:
        present = present & F.col(k).isNotNull()
    wanted = child.where(present).select(*child_keys).distinct()
    have = parent.select(*[F.col(p).alias(c) for c, p in zip(child_keys, parent_keys, strict=True)])
    return wanted.join(have, [*child_keys], "left_anti")


def key_text(keys: Sequence[str]) -> Column:
    """The values of a key as one text, ``-`` for NULL."""
    return F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in keys])


def unreferenced(
    child: DataFrame, parent: DataFrame, child_keys: Sequence[str], parent_keys: Sequence[str], rows: int | None = None
) -> DataFrame:
    """Q15: distinct child keys without a parent, as ``dangling``, with both tables in one aggregation.

    One exchange brings the two sides of a key together, with as many partitions as the ``rows`` of both tables need; they
    are counted if not given. Rows that share a key meet in one task, which keeps one of them.
    """
    names = [f"_k{i}" for i in range(len(child_keys))]

    def side(df: DataFrame, keys: Sequence[str], is_parent: bool) -> DataFrame:
        return df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.lit(is_parent).alias("_parent"))

    if rows is None:
        rows = child.count() + parent.count()
    both = spread(side(child, child_keys, False).unionByName(side(parent, parent_keys, True)).dropna(subset=names), names, rows)
    found = both.groupBy(*names).agg(F.bool_or("_parent").alias("_known")).where("NOT _known")
    return found.select(*[F.col(n).alias(k) for n, k in zip(names, child_keys)])


def audit_tables(
    tables: Mapping[str, DataFrame],
    rules: Mapping[str, Mapping[str, Column]],
    keys: Mapping[str, Sequence[str]],
    references: Sequence[tuple[str, Sequence[str], str, Sequence[str]]],
) -> DataFrame:
    """Q1 to Q9, Q15: all rules of all tables as (table_name, rule, key); an empty result is a pass.

    A table is scanned once for its row rules (one mask per row). A primary key costs one aggregation (``primary_key``: one
    row per key that several rows hold; rows with a NULL in the key break a NOT NULL rule instead), and so does a
    reference (``references <parent>``: one row per key without a parent; a NULL in the key refers to nothing).
    References whose tables are not both given are left out.
    """
    parts = []
    for name, df in tables.items():
        own = list(keys[name])
        found = duplicate_keys(df.dropna(subset=own), own).select(key_text(own).alias("key"), F.lit("primary_key").alias("rule"))
        if rules[name]:
            found = found.unionByName(violations(df.withColumn("key", key_text(own)), ["key"], rules[name]))
        parts.append(found.select(F.lit(name).alias("table_name"), "rule", "key"))
    named = {name for child, _, parent, _ in references for name in (child, parent) if child in tables and parent in tables}
    rows = {name: tables[name].count() for name in named}
    for child, child_keys, parent, parent_keys in references:
        if child in tables and parent in tables:
            lost = unreferenced(tables[child], tables[parent], child_keys, parent_keys, rows[child] + rows[parent])
            rule = f"{','.join(child_keys)} references {parent}"
            parts.append(lost.select(F.lit(child).alias("table_name"), F.lit(rule).alias("rule"), key_text(child_keys).alias("key")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


BLANK = r"(?U)^\s*$"


def sample_problems(
    images: DataFrame, pixels: DataFrame, datasets: Sequence[str], splits: Sequence[str]
) -> DataFrame:
    """What is malformed about an image's record or pixels, as (dataset, image_id, rule).

    ``images`` has dataset, image_id, split and abnormality_note, ``pixels`` dataset, image_id, row, col, r, g, b, in_fov and
    label, NULL for every pixel of an image without labels. Pixels are reduced to counters per image before any
    shuffle; a record without pixels breaks ``no pixels``. Records are compared by id, so one with an empty id is listed too.
    """
    level = [F.coalesce(F.col(c).between(0, 255), F.lit(False)) for c in ("r", "g", "b")]
    key = ["dataset", "image_id"]
    counted = pixels.groupBy(*key).agg(
        F.count("*").alias("_n"),
        F.count_if(F.col("row").isNull() | F.col("col").isNull() | (F.col("row") < 0) | (F.col("col") < 0)).alias("_off"),
        ((F.max("row") + 1).cast("bigint") * (F.max("col") + 1)).alias("_area"),
        F.count_if(~(level[0] & level[1] & level[2])).alias("_levels"),
        F.count_if(F.col("in_fov").isNull()).alias("_fov_gaps"),
        F.count_if(F.coalesce("in_fov", F.lit(False))).alias("_fov"),
        F.count("label").alias("_labels"),
    )
    rules = {
        "unknown dataset": ~F.coalesce(F.col("dataset").isin(list(datasets)), F.lit(False)),
        "unknown split": ~F.coalesce(F.col("split").isin(list(splits)), F.lit(False)),
        "empty image_id": F.coalesce(F.col("image_id") == "", F.lit(True)),
        "blank note": F.col("abnormality_note").rlike(BLANK),
        "no pixels": F.col("_n").isNull(),
        "not a full image": (F.col("_n") != F.col("_area")) | (F.col("_off") > 0),
        "channel value": F.col("_levels") > 0,
        "mask shape": F.col("_fov_gaps") > 0,
        "empty mask": F.col("_fov") == 0,
        "label shape": (F.col("_labels") > 0) & (F.col("_labels") < F.col("_n")),
    }
    joined = images.select(*key, "split", "abnormality_note").join(
        counted.withColumnsRenamed({"dataset": "_dataset", "image_id": "_image_id"}),
        F.col("dataset").eqNullSafe(F.col("_dataset")) & F.col("image_id").eqNullSafe(F.col("_image_id")), "left",
    )
    return violations(joined, key, {name: ~F.coalesce(bad, F.lit(False)) for name, bad in rules.items()})
