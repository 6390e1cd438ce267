"""Every constraint of the registry over all nine tables, made from the given ones with faults of each kind.

A table is a list of columns with an expression that Spark and DuckDB read alike; ``k`` is the row's number in its source.
Every column is NULL in some rows. Rules are stated once more as SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from maskaudit import schemas
from maskaudit.operators import quality
from workload.bindings import query, rgb_pixels, sql, table


def _timestamp(p: int) -> str:
    return (
        f"CASE WHEN k % {p} = 1 THEN '2026-01-02 03:04:05' WHEN k % {p + 2} = 1 THEN '2026-13-02T03:04:05Z'"
        f" WHEN k % {p + 4} = 1 THEN 'soon' ELSE '2026-01-02T03:04:05Z' END"
    )


def _unit(p: int) -> str:
    return f"(cast(k % {p} AS double) - 1) / {p - 4}"


# table: (source, row number, columns)
FAULTY: dict[str, tuple[str, str, dict[str, str]]] = {
    "images": ("part", "p_partkey", {
        "dataset": "CASE WHEN k % 41 = 0 THEN 'other' WHEN k % 3 = 0 THEN 'stare' ELSE 'drive' END",
        "image_id": "concat('i', cast(k - k % 23 % 2 AS string))", "patient_id": "concat('p', cast(k % 9 AS string))",
        "split": "CASE WHEN k % 43 = 0 THEN 'dev' WHEN k % 2 = 0 THEN 'test' ELSE 'training' END",
        "has_abnormality": "k % 5 = 0", "abnormality_note": "CASE WHEN k % 10 = 0 THEN 'note' WHEN k % 15 = 0 THEN '' END",
        "fov_pixels": "k % 47", "fov_source": "CASE WHEN k % 37 = 0 THEN 'guessed' ELSE 'official' END",
        "vessel_fraction_in_fov": _unit(53), "has_labels": "k % 4 <> 0",
    }),
    "frozen_models": ("supplier", "s_suppkey", {
        "model_id": "concat('m', cast(k % 77 AS string))", "run_id": "concat('r', cast(k * 3 AS string))",
        "checkpoint_sha256": "md5(cast(k AS string))", "threshold": _unit(19), "n_epochs": "k % 13", "git_commit": "'c0'",
        "frozen_at": _timestamp(7),
    }),
    "runs": ("orders", "o_orderkey", {
        "run_id": "concat('r', cast(k - k % 29 % 2 AS string))", "variant": "o_orderpriority", "config": "'{}'",
        "config_hash": "md5(cast(k AS string))", "seed": "o_custkey", "git_commit": "'c0'", "git_dirty": "k % 4 = 0",
        "git_tag": "CASE WHEN k % 3 <> 0 THEN 'v0.1.0' END", "data_hash": "o_orderstatus", "python_version": "'3.13'",
        "tensorflow_version": "'2.21'", "cuda_version": "'12.5'", "device": "'gpu'", "gpu_type": "'Tesla T4'",
        "compute_platform": "'colab'", "deterministic_ops": "k % 11 <> 0",
        "frozen_model_id": "CASE WHEN k % 13 = 0 THEN concat('m', cast(k % 99 AS string)) END",
        "applied_threshold": f"CASE WHEN k % 26 <> 1 THEN {_unit(31)} END", "started_at": _timestamp(17),
        "finished_at": f"CASE WHEN k % 5 <> 0 THEN {_timestamp(101)} END", "is_reported": "k % 6 = 1",
    }),
    "fold_assignments": ("lineitem", "l_orderkey * 8 + l_linenumber", {
        "run_id": "concat('r', cast(l_orderkey AS string))", "fold": "l_linenumber % 5",
        "dataset": "CASE WHEN l_partkey % 3 = 0 THEN 'stare' ELSE 'drive' END", "image_id": "concat('i', cast(l_partkey AS string))",
        "role": "CASE WHEN k % 61 = 0 THEN 'holdout' WHEN l_returnflag = 'A' THEN 'train' WHEN l_returnflag = 'R' THEN 'val' ELSE 'test' END",
    }),
    "fold_status": ("lineitem", "l_orderkey * 8 + l_linenumber", {
        "run_id": "concat('r', cast(l_orderkey AS string))", "fold": "l_linenumber % 6",
        "status": "CASE WHEN k % 67 = 0 THEN 'paused' WHEN l_linestatus = 'F' THEN 'complete' ELSE 'running' END",
        "checkpoint_sha256": "CASE WHEN k % 9 <> 0 THEN md5(cast(k AS string)) END", "started_at": _timestamp(97),
        "completed_at": f"CASE WHEN k % 8 <> 0 THEN {_timestamp(89)} END", "attempts": "k % 71",
    }),
    "thresholds": ("customer", "c_custkey", {
        "run_id": "concat('r', cast(k * 4 AS string))", "fold": "k % 6", "threshold": _unit(59), "selection_rule": "'best'",
        "val_dice": _unit(73),
    }),
    "per_image_metrics": ("lineitem", "l_orderkey * 8 + l_linenumber", {
        "run_id": "concat('r', cast(l_orderkey AS string))",
        "dataset": "CASE WHEN l_partkey % 3 = 0 THEN 'stare' ELSE 'drive' END", "image_id": "concat('i', cast(l_partkey AS string))",
        "fold": "l_linenumber % 7", "prediction_mode": "CASE WHEN k % 79 = 0 THEN 'mean' WHEN k % 2 = 0 THEN 'tta' ELSE 'single' END",
        **{c: _unit(103 + 2 * i) for i, c in enumerate(schemas.RATIO_COLUMNS)}, "mean_uncertainty": "k % 83 - 1",
    }),
    "risk_coverage": ("events", "event_id", {
        "run_id": "concat('r', cast(user_id AS string))", "dataset": "'drive'", "image_id": "concat('i', cast(user_id AS string))",
        "fraction_referred": _unit(109), "dice_retained": _unit(113),
    }),
    "training_history": ("events", "event_id", {
        "run_id": "concat('r', cast(user_id AS string))", "fold": "user_id % 5 - 1", "epoch": "k % 127 - 1",
        "train_loss": "value", "val_dice": _unit(131),
    }),
}

# What each rule of ``schemas.rules`` says, for DuckDB; units, minima and NOT NULL follow from their lists.
SAID: dict[str, dict[str, str]] = {
    "images": {
        "dataset_enum": "dataset IN ('drive', 'stare', 'chase')", "split_enum": "split IN ('training', 'test', 'external')",
        "fov_source_enum": "fov_source IN ('official', 'generated')", "fov_pixels_min": "fov_pixels >= 1",
        "fraction_needs_labels": "has_labels OR vessel_fraction_in_fov IS NULL",
        "abnormal_iff_note": "has_abnormality = (abnormality_note IS NOT NULL AND abnormality_note <> '')",
    },
    "frozen_models": {"n_epochs_min": "n_epochs >= 1"},
    "runs": {
        "reported_needs_clean_tree": "NOT is_reported OR NOT git_dirty", "reported_needs_tag": "NOT is_reported OR git_tag IS NOT NULL",
        "reported_needs_finish": "NOT is_reported OR finished_at IS NOT NULL",
        "model_and_threshold_together": "(frozen_model_id IS NULL) = (applied_threshold IS NULL)",
    },
    "fold_assignments": {"role_enum": "role IN ('train', 'val', 'test')", "fold_min": "fold >= 1"},
    "fold_status": {
        "status_enum": "status IN ('running', 'complete')", "fold_min": "fold >= 1", "attempts_min": "attempts >= 1",
        "complete_needs_outputs": "status = 'running' OR (checkpoint_sha256 IS NOT NULL AND completed_at IS NOT NULL)",
    },
    "thresholds": {"fold_min": "fold >= 1"},
    "per_image_metrics": {
        "prediction_mode_enum": "prediction_mode IN ('single', 'tta')", "fold_min": "fold >= 1", "mean_uncertainty_min": "mean_uncertainty >= 0",
    },
    "risk_coverage": {},
    "training_history": {"fold_min": "fold >= 0", "epoch_min": "epoch >= 0"},
}
UNITS = {
    "images": ("vessel_fraction_in_fov",), "frozen_models": ("threshold",), "runs": ("applied_threshold",),
    "thresholds": ("threshold", "val_dice"), "per_image_metrics": schemas.RATIO_COLUMNS,
    "risk_coverage": ("fraction_referred", "dice_retained"), "training_history": ("val_dice",),
}
STAMPS = {"frozen_models": ("frozen_at",), "runs": ("started_at", "finished_at"), "fold_status": ("started_at", "completed_at")}


def _columns(name: str) -> dict[str, str]:
    return {
        c: f"CASE WHEN (k + {17 * j}) % 499 <> 5 THEN {text} END" for j, (c, text) in enumerate(FAULTY[name][2].items())
    }


def faulty_tables(spark, sf):
    """The nine tables, with the types of their schema."""
    out = {}
    for name, (source, number, _) in FAULTY.items():
        rows = table(spark, sf, source).withColumn("k", F.expr(number).cast("bigint"))
        made = rows.select(*[F.expr(text).alias(c) for c, text in _columns(name).items()])
        out[name] = made.to(spark.createDataFrame([], schemas.TABLES[name]).schema)
    return out


def _said(name: str) -> dict[str, str]:
    form = "'%Y-%m-%dT%H:%M:%SZ'"
    return (
        SAID[name]
        | {f"{c}_unit": f"{c} BETWEEN 0 AND 1" for c in UNITS.get(name, ())}
        | {f"{c}_format": f"coalesce(strftime(try_strptime({c}, {form}), {form}) = {c}, {c} IS NULL)" for c in STAMPS.get(name, ())}
        | {f"{c}_not_null": f"{c} IS NOT NULL" for c in [*schemas.KEYS[name], *schemas.REQUIRED[name]]}
    )


def _text(keys) -> str:
    return "concat_ws('/', " + ", ".join(f"coalesce(cast({k} AS varchar), '-')" for k in keys) + ")"


def constraints_sql(kinds: str) -> str:
    """SQL of all constraints whose name matches the regular expression ``kinds``."""
    import re

    heads, parts = [], []
    for name, (source, number, _) in FAULTY.items():
        made = ", ".join(f"{text} AS {c}" for c, text in _columns(name).items())
        heads.append(f"t_{name} AS MATERIALIZED (SELECT {made} FROM (SELECT *, {number} AS k FROM {source}))")
        key, own = _text(schemas.KEYS[name]), ", ".join(schemas.KEYS[name])
        full = " AND ".join(f"{c} IS NOT NULL" for c in schemas.KEYS[name])
        parts += [
            f"SELECT '{name}' AS table_name, '{rule}' AS rule, {key} AS key FROM t_{name} WHERE NOT ({text})"
            for rule, text in _said(name).items() if re.search(kinds, rule)
        ]
        if re.search(kinds, "primary_key"):
            parts.append(f"SELECT '{name}' AS table_name, 'primary_key' AS rule, {key} AS key FROM t_{name} WHERE {full} GROUP BY {own} HAVING count(*) > 1")
    for child, mine, parent, theirs in schemas.REFERENCES:
        rule = f"{','.join(mine)} references {parent}"
        if re.search(kinds, rule):
            same = " AND ".join(f"c.{a} = p.{b}" for a, b in zip(mine, theirs))
            full = " AND ".join(f"{c} IS NOT NULL" for c in mine)
            parts.append(
                f"SELECT DISTINCT '{child}' AS table_name, '{rule}' AS rule, {_text(mine)} AS key FROM t_{child} c WHERE {full}"
                f" AND NOT EXISTS (SELECT 1 FROM t_{parent} p WHERE {same})"
            )
    return "WITH " + ",\n".join(heads) + "\n" + "\nUNION ALL ".join(parts)


def _audit(spark, sf, kinds: str):
    import re

    found = {n: {r: c for r, c in schemas.rules(n).items() if re.search(kinds, r)} for n in FAULTY}
    return quality.audit_tables(faulty_tables(spark, sf), found, schemas.KEYS, schemas.REFERENCES)


@query("dq_registry", constraints_sql(""))
def dq_registry(spark, sf):
    """Every row rule, primary key and reference of the nine tables, in one plan."""
    return _audit(spark, sf, "")


@query("dq_all_enums", constraints_sql("_enum$"))
def dq_all_enums(spark, sf):
    return _audit(spark, sf, "_enum$").where("rule LIKE '%_enum'")


@query("dq_all_ranges", constraints_sql("_(unit|min)$"))
def dq_all_ranges(spark, sf):
    return _audit(spark, sf, "_(unit|min)$").where("rule LIKE '%_unit' OR rule LIKE '%_min'")


@query("dq_all_keys", constraints_sql("^primary_key$"))
def dq_all_keys(spark, sf):
    return quality.audit_tables(faulty_tables(spark, sf), {n: {} for n in FAULTY}, schemas.KEYS, [])


@query("dq_all_references", constraints_sql(" references "))
def dq_all_references(spark, sf):
    return _audit(spark, sf, "^$").where("rule LIKE '% references %'")


SAMPLE_SQL = """SELECT dataset, image_id, rule FROM (SELECT dataset, image_id, unnest([
  CASE WHEN dataset IS NULL OR dataset NOT IN ('drive', 'stare', 'chase') THEN 'unknown dataset' END,
  CASE WHEN split IS NULL OR split NOT IN ('training', 'test', 'external') THEN 'unknown split' END,
  CASE WHEN image_id = '' THEN 'empty image_id' END,
  CASE WHEN regexp_full_match(abnormality_note, '\\s*') THEN 'blank note' END,
  CASE WHEN n IS NULL THEN 'no pixels' END, CASE WHEN n <> h * w THEN 'not a full image' END,
  CASE WHEN bad_levels > 0 THEN 'channel value' END, CASE WHEN gaps > 0 THEN 'mask shape' END,
  CASE WHEN fov = 0 THEN 'empty mask' END, CASE WHEN labels > 0 AND labels < n THEN 'label shape' END]) AS rule
  FROM records LEFT JOIN tallies USING (dataset, image_id)) WHERE rule IS NOT NULL"""
RECORD = {
    "dataset": "CASE WHEN k % 31 = 0 THEN 'other' ELSE 'drive' END",
    "image_id": "CASE WHEN k = 29 THEN '' WHEN k % 37 = 0 THEN concat('gone', cast(k AS string)) ELSE cast(k AS string) END",
    "split": "CASE WHEN k % 23 = 0 THEN NULL WHEN k % 19 = 0 THEN 'dev' ELSE 'training' END",
    "abnormality_note": "CASE WHEN k % 17 = 0 THEN '  ' WHEN k % 13 = 0 THEN '' WHEN k % 2 = 0 THEN 'note' END",
}
PIXEL = {
    "row": "CASE WHEN k % 11 = 0 AND row = 7 AND col = 7 THEN 8 ELSE row END", "col": "col",
    "r": "CASE WHEN k % 12 = 0 AND col = 3 THEN 256 ELSE r END", "g": "CASE WHEN k % 14 = 0 AND row = 2 THEN NULL ELSE g END", "b": "b",
    "in_fov": "CASE WHEN k % 16 = 0 THEN false WHEN k % 18 = 0 AND row = 0 THEN NULL ELSE in_fov END",
    "label": "CASE WHEN k % 5 = 0 THEN NULL WHEN k % 22 = 0 AND col = 1 THEN NULL ELSE r > 100 END",
}


def _named(columns: dict[str, str]) -> str:
    return ", ".join(f"{text} AS {c}" for c, text in columns.items())


@query(
    "sample_problems",
    sql("", "rgb_pixels").rstrip() + f""",
records AS (SELECT {_named(RECORD)} FROM (SELECT vec_id AS k FROM embeddings)),
marked AS (SELECT 'drive' AS dataset, cast(k AS varchar) AS image_id, {_named(PIXEL)} FROM (SELECT *, image_id AS k FROM rgb_pixels)),
tallies AS (SELECT dataset, image_id, count(*) AS n, max(row) + 1 AS h, max(col) + 1 AS w,
  count(*) FILTER (NOT coalesce(r BETWEEN 0 AND 255 AND g BETWEEN 0 AND 255 AND b BETWEEN 0 AND 255, false)) AS bad_levels,
  count(*) FILTER (in_fov IS NULL) AS gaps, count(*) FILTER (in_fov) AS fov, count(label) AS labels FROM marked GROUP BY ALL)
""" + SAMPLE_SQL,
)
def sample_problems(spark, sf):
    """Malformed records and pixels of the colour images, with faults of every kind."""
    records = table(spark, sf, "embeddings").select(F.col("vec_id").alias("k")).select(*[F.expr(t).alias(c) for c, t in RECORD.items()])
    rows = rgb_pixels(spark, sf).withColumn("k", F.col("image_id"))
    marked = rows.select(
        F.lit("drive").alias("dataset"), F.col("image_id").cast("string").alias("image_id"), *[F.expr(t).alias(c) for c, t in PIXEL.items()]
    )
    return quality.sample_problems(records, marked, ("drive", "stare", "chase"), ("training", "test", "external"))
