"""Fold invariants, patches, ranks, quantiles and bootstrap intervals."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskaudit.operators import folds, patches, ranking, stats


def ids(spark, names):
    return spark.createDataFrame([(n,) for n in names], "image_id string")


NAMES = [f"{i:02d}" for i in range(21, 41)]
SPREAD = ["25", "26", "32"]


def rows_of(df):
    return sorted((r.fold, r.image_id, r.role) for r in df.collect())


def test_fold_sizes_and_spread(spark):
    rows = rows_of(folds.make_folds(ids(spark, NAMES), "image_id", SPREAD, 5, 2, 1))
    assert len(rows) == 100
    for fold in range(1, 6):
        roles = [role for f, _, role in rows if f == fold]
        assert (roles.count("test"), roles.count("val"), roles.count("train")) == (4, 2, 14)
    tests = {i: f for f, i, role in rows if role == "test"}
    assert sorted(tests) == NAMES
    assert len({tests[i] for i in SPREAD}) == 3


def test_folds_depend_on_the_set_and_the_seed(spark):
    plan = rows_of(folds.make_folds(ids(spark, NAMES), "image_id", SPREAD, 5, 2, 1))
    shuffled = ids(spark, NAMES[::-1]).repartition(3)
    assert rows_of(folds.make_folds(shuffled, "image_id", SPREAD[::-1], 5, 2, 1)) == plan
    assert rows_of(folds.make_folds(ids(spark, NAMES), "image_id", SPREAD, 5, 2, 2)) != plan


@pytest.mark.parametrize(
    "names, spread, n_folds, n_val, message",
    [
        (NAMES + ["21"], [], 5, 2, "duplicates"),
        (NAMES, ["25", "25"], 5, 2, "duplicates"),
        (NAMES, [], 3, 2, "cannot split"),
        (NAMES, ["99"], 5, 2, "not among"),
        (NAMES, NAMES[:6], 5, 2, "cannot spread"),
        (NAMES, [], 5, 16, "no training"),
    ],
)
def test_fold_errors(spark, names, spread, n_folds, n_val, message):
    with pytest.raises(ValueError, match=message):
        folds.make_folds(ids(spark, names), "image_id", spread, n_folds, n_val, 1)


def test_signatures_tell_sets_apart(spark):
    schema = "run_id string, fold int, image_id string, role string"
    base = [("a", 1, "x", "test"), ("a", 1, "y", "train"), ("a", 2, "y", "test")]
    same = [("b", f, i, r) for _, f, i, r in reversed(base)]
    other = [("c", 1, "x", "test"), ("c", 1, "y", "val"), ("c", 2, "y", "test")]
    out = folds.fold_signatures(spark.createDataFrame(base + same + other, schema)).collect()
    sig = {r.run_id: (r.sig_rows, r.sig_a, r.sig_b) for r in out}
    assert sig["a"] == sig["b"] != sig["c"]


def test_running_counts_are_exact_under_skew(spark):
    """One group holds most rows; ranks must still be 0..n-1 in order."""
    rows = [("hot", i * 7919 % 5000) for i in range(5000)] + [("cold", i) for i in range(7)] + [(None, 1)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(8)
    out = ranking.running_counts(df, ["g"], [F.col("v")]).collect()
    for group in ("hot", "cold", None):
        ranked = sorted((r.v, r.n_before) for r in out if r.g == group)
        assert [n for _, n in ranked] == list(range(len(ranked)))
    assert {r.n_total for r in out if r.g == "hot"} == {5000}


def test_keyed_rank_is_a_permutation(spark):
    df = spark.range(3000).withColumn("d", F.floor(F.rand(1) * F.lit(float(2**59))).cast("bigint"))
    ranks = [r["rank"] for r in ranking.keyed_rank(df, [], "d", "id").collect()]
    assert sorted(ranks) == list(range(3000))


@pytest.mark.parametrize("method", ["linear", "inverted_cdf"])
def test_quantiles_equal_numpy(spark, method):
    values = np.round(np.random.default_rng(4).normal(size=400), 2)
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 3.0)], "g string, v double")
    wanted = {"low": 0.025, "mid": 0.5, "high": 0.99}
    out = {r.g: r for r in ranking.exact_quantiles(df, ["g"], "v", wanted, method).collect()}
    for name, q in wanted.items():
        assert out["a"][name] == pytest.approx(np.quantile(values, q, method=method))
        assert out["b"][name] == 3.0


def values(spark, data, metric="m"):
    rows = [(metric, f"{i:03d}", float(v)) for i, v in enumerate(data)]
    return spark.createDataFrame(rows, "metric string, image_id string, value double")


def test_summary(spark):
    row = stats.summarize(values(spark, [1, 2, 3, 4]), ["metric"]).first()
    assert (row.n, row["mean"], row.median, row.minimum, row.maximum) == (4, 2.5, 2.5, 1.0, 4.0)
    assert row.sd == pytest.approx(math.sqrt(5 / 3))


def test_bootstrap_intervals(spark):
    def ci(df):
        return {r.metric: (r.ci_low, r.ci_high) for r in stats.bootstrap_mean_ci(
            df, ["metric"], "image_id", 500, 1, 0.95).collect()}

    assert ci(values(spark, [0, 1]))["m"] == (0.0, 1.0)
    low, high = ci(values(spark, [0.7] * 20))["m"]
    assert low == pytest.approx(0.7) and high == pytest.approx(0.7)
    data = np.random.default_rng(0).random(30)
    both = values(spark, data).unionByName(values(spark, data * 2, "twice"))
    out = ci(both)
    assert out["twice"] == pytest.approx(tuple(2 * v for v in out["m"]))
    assert out["m"][0] < data.mean() < out["m"][1]
    with pytest.raises(ValueError, match="level"):
        stats.bootstrap_mean_ci(both, ["metric"], "image_id", 10, 1, 1.0)


def grid(spark):
    rows = [(i, r, c, float(r * 5 + c), (r + c) % 2 == 0, r < 4) for i in range(3) for r in range(5) for c in range(5)]
    return spark.createDataFrame(rows, "image_id int, row int, col int, x double, label boolean, in_fov boolean")


def test_centres_lie_in_the_mask(spark):
    out = patches.sample_centers(grid(spark), "image_id", 200, 3).collect()
    assert sorted(r.patch_id for r in out) == list(range(200))
    assert all(r.row < 4 for r in out) and {r.image_id for r in out} == {0, 1, 2}
    with pytest.raises(ValueError, match="at least one"):
        patches.sample_centers(grid(spark), "image_id", 0, 3)


def test_switching_a_step_off_keeps_the_other_draws(spark):
    p = spark.range(50).withColumnRenamed("id", "patch_id")
    on = patches.sample_augmentation(p, 1).orderBy("patch_id").collect()
    off = patches.sample_augmentation(p, 1, rot90=False, flip_probability=0.0).orderBy("patch_id").collect()
    assert all(r.rotations == 0 and not r.flip_rows for r in off)
    assert [r.contrast for r in on] == [r.contrast for r in off]
    assert {r.rotations for r in on} == {0, 1, 2, 3}


@pytest.mark.parametrize("k", [0, 1, 2, 3])
def test_patches_move_like_numpy(spark, k):
    centers = spark.createDataFrame([(0, 1, 2, 3)], "patch_id long, image_id int, row int, col int")
    centers = centers.withColumns({"flip_rows": F.lit(True), "flip_cols": F.lit(False), "rotations": F.lit(k)})
    crop = patches.crop(centers, grid(spark), "image_id", "x", 4, ("flip_rows", "flip_cols", "rotations"))
    out = np.zeros((4, 4))
    for r in patches.augment_geometry(crop, 4).collect():
        out[r.pr, r.pc] = r.x
    padded = np.pad(np.arange(25.0).reshape(5, 5), 2)
    assert (out == np.rot90(padded[2:6, 3:7][::-1], k)).all()


def test_identity_jitter_returns_the_patch(spark):
    data = patches.patch_dataset(
        grid(spark), "image_id", "x", size=4, n=10, batch_size=4, seed=2,
        rot90=False, flip_probability=0.0, brightness_delta=0.0, contrast_range=(1.0, 1.0),
    ).collect()
    assert sorted((r.batch_id, r.slot) for r in data) == [(i // 4, i % 4) for i in range(10)]
    assert all(len(r.x) == 16 and all(x == 0 for x, w in zip(r.x, r.w) if w == 0) for r in data)
