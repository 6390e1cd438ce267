"""Radix selection, count matrices, envelopes, frontiers and constraint masks against plain computations."""

import hashlib
import math
import os
import random
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskaudit import schemas
from maskaudit.functions import draws
from maskaudit.operators import metrics, patches, quality, ranking, spatial, stats
from maskaudit.plans import queries, reports
from maskaudit.sources import tables
from workload import bindings

SF = "/root/testdata/sf0.001"


def bits(v):
    if v != v:
        return (2047 << 52) + 1
    size = struct.unpack("<q", struct.pack("<d", abs(v)))[0]
    return -size if v < 0 else size


def test_order_keys_are_the_bits_of_a_double(spark):
    rng = random.Random(1)
    values = [0.0, -0.0, math.inf, -math.inf, math.nan, 5e-324, -5e-324, 2.0**-1023, 1.7976931348623157e308]
    for k in range(-1074, 1024):
        x = 2.0**k
        values += [x, -x, math.nextafter(x, 0), math.nextafter(x, math.inf)]
    values += [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(20_000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = df.select("v", ranking.order_key(F.col("v")).alias("k")).collect()
    assert all(r.k == bits(r.v) for r in rows)


@pytest.mark.parametrize("method", ["linear", "inverted_cdf"])
def test_quantiles_of_hard_values(spark, method):
    """Values over all magnitudes, neighbours that differ in the last bit, one value that most rows hold, NULL groups."""
    rng = np.random.default_rng(7)
    near = [1.0]
    for _ in range(200):
        near.append(math.nextafter(near[-1], 2))
    groups = {
        "wide": np.concatenate((10.0 ** rng.uniform(-300, 300, 400), -(10.0 ** rng.uniform(-300, 300, 400)))),
        "near": np.array(near), "hot": np.array([0.5] * 3000 + [0.25, 0.75]), None: np.array([2.0, 1.0]), "one": np.array([-3.0]),
    }
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("wide", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    wanted = {"zero": 0.0, "low": 0.1, "mid": 0.5, "high": 0.99, "one": 1.0}
    out = {r.g: r for r in ranking.exact_quantiles(df, ["g"], "v", wanted, method).collect()}
    assert set(out) == set(groups)
    for g, values in groups.items():
        for name, q in wanted.items():
            assert out[g][name] == pytest.approx(np.quantile(values, q, method=method), rel=1e-12)
    plan = ranking.exact_quantiles(df, ["g"], "v", wanted, method)._jdf.queryExecution().toString()
    assert "RangePartitioning" not in plan and "rangepartitioning" not in plan
    assert ranking.exact_quantiles(df.where("false"), ["g"], "v", wanted, method).count() == 0


def plain_bootstrap(values, ids, resamples, seed, level):
    def draw(*key):
        return int(hashlib.md5("|".join(map(str, key)).encode()).hexdigest()[:15], 16)

    order = sorted(range(len(ids)), key=lambda k: (draw(seed, "position", ids[k]), ids[k]))
    placed = np.array([values[k] for k in order])
    n = len(placed)
    means = [np.mean([placed[draw(seed, "bootstrap", r, j) % n] for j in range(n)]) for r in range(resamples)]
    return np.quantile(means, [(1 - level) / 2, 1 - (1 - level) / 2])


@pytest.mark.parametrize("blocks", [(128, 4096, 256), (3, 4, 2)])
def test_bootstrap_is_that_of_single_draws(spark, monkeypatch, blocks):
    for name, value in zip(("DRAWS", "POSITIONS", "SIZES"), blocks):
        monkeypatch.setattr(stats, name, value)
    rng = np.random.default_rng(8)
    groups = {"a": rng.random(11), "b": rng.random(11), "c": rng.random(5), "d": rng.random(1), None: rng.random(4)}
    rows = [(g, f"i{k}", float(v)) for g, values in groups.items() for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "g string, image_id string, value double").repartition(3)
    out = {r.g: r for r in stats.bootstrap_mean_ci(df, ["g"], "image_id", 40, 5, 0.9).collect()}
    assert set(out) == set(groups)
    for g, values in groups.items():
        low, high = plain_bootstrap(values, [f"i{k}" for k in range(len(values))], 40, 5, 0.9)
        assert (out[g].ci_low, out[g].ci_high) == (pytest.approx(low), pytest.approx(high))


@pytest.mark.parametrize("cells", [4, 12, 1 << 23])
def test_bootstrap_of_groups_in_pieces_and_chunks(spark, monkeypatch, cells):
    for name, value in (("POSITIONS", 4), ("CELLS", cells), ("COLUMNS", 2), ("LANES", 3), ("DRAWN", 50)):
        monkeypatch.setattr(stats, name, value)
    rng = np.random.default_rng(4)
    groups = {"a": rng.random(31), "b": rng.random(31), "c": rng.random(17), "d": rng.random(1), "e": rng.random(16)}
    rows = [(g, f"i{k}", float(v)) for g, values in groups.items() for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "g string, image_id string, value double").repartition(3)
    out = {r.g: r for r in stats.bootstrap_mean_ci(df, ["g"], "image_id", 25, 5, 0.9).collect()}
    assert set(out) == set(groups)
    for g, values in groups.items():
        low, high = plain_bootstrap(values, [f"i{k}" for k in range(len(values))], 25, 5, 0.9)
        assert (out[g].ci_low, out[g].ci_high) == (pytest.approx(low), pytest.approx(high))


@pytest.mark.parametrize("purpose", ["bootstrap", "x" * 46])
def test_draw_tables_are_single_draws(purpose):
    for rows, columns in ((range(0, 12), range(0, 120)), (range(98, 102), range(99_990, 100_020)), (range(3), range(0))):
        got = draws.draw_table(20260927, purpose, rows, columns)
        want = [
            [int(hashlib.md5(f"20260927|{purpose}|{r}|{j}".encode()).hexdigest()[: draws.DRAW_HEX_DIGITS], 16) for j in columns]
            for r in rows
        ]
        assert got.tolist() == want


def exchanged(plan):
    """Bytes that the exchanges of a plan that has run have written."""
    name = plan.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return exchanged(plan.executedPlan())
    if "QueryStage" in name:
        return exchanged(plan.plan())
    if name.startswith("ReusedExchange"):
        return 0
    own = plan.metrics().get("dataSize").get().value() if name == "Exchange" else 0
    children = plan.children()
    return own + sum(exchanged(children.apply(i)) for i in range(children.size()))


def test_draws_of_the_bootstrap_are_not_shuffled(spark):
    df = spark.range(3000).select(
        F.lit("g").alias("g"), F.col("id").cast("string").alias("image_id"), (F.col("id") % 7).cast("double").alias("value")
    )

    def written(resamples):
        out = stats.bootstrap_mean_ci(df, ["g"], "image_id", resamples, 1, 0.9)
        out.collect()
        return exchanged(out._jdf.queryExecution().executedPlan())

    few, many = written(100), written(1000)
    assert 0 < few and many - few < 900 * 500  # 900 x 3000 draws


def test_values_are_read_once_for_all_passes(spark):
    rows = [(f"r{k % 3}", f"i{k}", float(k % 7)) for k in range(60)]
    df = spark.createDataFrame(rows, "run_id string, image_id string, value double").repartition(4, "run_id")
    out = stats.summarize(df.withColumn("metric", F.lit("m")), ["run_id", "metric"])
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("REPARTITION_BY_COL") - final.count("ReusedExchange") <= 2


def scans(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("FileScan")


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_the_passes_of_a_report_work_the_metrics_out_once(spark):
    metric_rows = bindings.eval_metrics(spark, SF)
    values = stats.long_metrics(metric_rows, ["run_id"], "image_id", ("dice", "auc_roc"))
    assert scans(stats.bootstrap_mean_ci(values, ["run_id", "metric"], "image_id", 20, 1, 0.9)) <= scans(values)
    # The images and, behind another filter, one more exchange of the pixels.
    t = bindings.eval_tables(spark, SF)
    assert scans(reports.headline(t, bindings.DATASET, resamples=20)) <= scans(metric_rows) + 2
    widths = stats.summarize(reports._long(queries.held_out(metric_rows, bindings.DATASET), reports.WIDTHS), ["run_id", "metric"])
    assert scans(reports.width_summary(t, bindings.DATASET, resamples=20)) <= scans(widths)


def test_envelopes_equal_brute_force():
    rng = np.random.default_rng(9)
    for _ in range(200):
        n, w = rng.integers(1, 6), rng.integers(1, 25)
        squares = rng.integers(0, 30, (n, w)) ** 2
        c = np.arange(w)
        want = ((c[None, :, None] - c[None, None, :]) ** 2 + squares[:, None, :]).min(axis=2)
        assert (spatial._lower_envelope(squares) == want).all()


def test_steps_grow_with_the_line_not_with_its_width_times_radius():
    def steps(width):
        g = np.minimum(np.arange(width), width - np.arange(width)).astype(np.int64) + 1
        start = time.process_time()
        for _ in range(3):
            spatial._line_distances(np.zeros(width, dtype=np.int64), np.arange(width), g)
        return time.process_time() - start

    steps(500)
    assert steps(16_000) < 10 * steps(4_000)


def test_distances_of_a_wide_vessel(spark):
    rows = [("a", r, c, True, True) for r in range(60) for c in range(80)] + [("a", 30, 40, False, True)]
    rows = [x for x in rows if x[1:4] != (30, 40, True)]
    df = spark.createDataFrame(rows, "image_id string, row int, col int, label boolean, in_fov boolean").repartition(4)
    got = {(r.row, r.col): r.d2 for r in spatial.squared_distance(df, ["image_id"]).collect()}
    want = {
        (r, c): min((r + 1) ** 2, (60 - r) ** 2, (c + 1) ** 2, (80 - c) ** 2, (r - 30) ** 2 + (c - 40) ** 2)
        for r in range(60) for c in range(80) if (r, c) != (30, 40)
    }
    assert got == want


def test_a_frontier_shrinks_and_its_tables_go(spark, monkeypatch):
    """Thin lines are done after a round; only the blocks around one wide square go on."""
    sizes, kept = [], []
    put = spatial.Rounds.put

    def counted(self, df):
        out = put(self, df)
        sizes.append(out.count())
        kept.append(self)
        return out

    monkeypatch.setattr(spatial.Rounds, "put", counted)
    label = np.zeros((96, 96), dtype=bool)
    label[::6, :] = True
    label[40:60, 40:60] = True
    r, c = np.nonzero(label)
    rows = [("a", int(i), int(j), True, True) for i, j in zip(r, c)]
    df = spark.createDataFrame(rows, "image_id string, row int, col int, label boolean, in_fov boolean")
    got = {(x.row, x.col) for x in spatial.skeleton(df, ["image_id"], block=8, passes=1).collect()}
    mask = label
    while True:
        after = spatial._thin_half(spatial._thin_half(mask, 0), 1)
        if (after == mask).all():
            break
        mask = after
    assert got == {(int(i), int(j)) for i, j in np.argwhere(mask)}
    whole = [n for n in sizes if n == sizes[0]]  # the first round, every eighth compaction and the result
    frontier = [n for n in sizes if n < sizes[0]]
    assert len(whole) <= 2 + len(sizes) // 8 and len(frontier) > 3 and max(frontier) < sizes[0] / 4
    assert frontier[-1] < frontier[0]
    left = [d for d in os.listdir(kept[0].root.removeprefix("file:")) if not d.startswith(".")]
    assert len(left) == 1


def test_centres_are_the_drawn_mask_pixels(spark, monkeypatch):
    monkeypatch.setattr(patches, "BAND", 5)
    rng = np.random.default_rng(10)
    rows = [(f"i{k}", r, c, bool(rng.random() < 0.6)) for k in range(4) for r in range(9) for c in range(11)]
    df = spark.createDataFrame(rows, "image_id string, row int, col int, in_fov boolean").repartition(4)
    got = {x.patch_id: (x.image_id, x.row, x.col) for x in patches.sample_centers(df, "image_id", 300, 3).collect()}

    def draw(*key):
        return int(hashlib.md5("|".join(map(str, key)).encode()).hexdigest()[:15], 16)

    inside = {}
    for i, r, c, m in rows:
        if m:
            inside.setdefault(i, []).append((r, c))
    order = sorted(inside, key=lambda i: (draw(3, "image order", i), i))
    for patch in range(300):
        image = order[draw(3, "image", patch) % len(order)]
        place = sorted(inside[image])[draw(3, "pixel", patch) % len(inside[image])]
        assert got[patch] == (image, *place)


def test_masks_and_references_of_a_small_registry(spark):
    parents = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), (None, 1, "x"), ("b", None, "z")], "k string, n int, v string")
    children = spark.createDataFrame([("a",), ("c",), ("c",), (None,)], "p string")
    rules = {"p": {"n_min": F.col("n") >= 2, "v_enum": F.col("v").isin("x"), "k_not_null": F.col("k").isNotNull()}, "c": {}}
    out = quality.audit_tables({"p": parents, "c": children}, rules, {"p": ["k"], "c": ["p"]}, [("c", ["p"], "p", ["k"])])
    assert sorted(map(tuple, out.collect())) == sorted([
        ("p", "n_min", "a"), ("p", "n_min", "a"), ("p", "n_min", "-"), ("p", "v_enum", "a"), ("p", "v_enum", "b"), ("p", "k_not_null", "-"),
        ("p", "primary_key", "a"), ("c", "primary_key", "c"), ("c", "p references p", "c"),
    ])
    with pytest.raises(ValueError, match="mask"):
        quality.broken_mask([F.lit(True)] * 63)


def test_another_layout_is_refused(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    row = {"run_id": "r", "fold": 1, "threshold": 0.5, "selection_rule": "best", "val_dice": 0.75}
    good = spark.createDataFrame([row], tables.table_schema("thresholds"))
    tables.append(good, root, "thresholds")
    tables.append(good.withColumn("fold", F.lit(2)), root, "thresholds")
    assert tables.read_table(spark, root, "thresholds").count() == 2
    tables.check_layout(spark, root, "thresholds", every_file=True)
    with pytest.raises(ValueError, match="fold is string"):
        tables.append(good.withColumn("fold", F.lit("two")), root, "thresholds")
    with pytest.raises(ValueError, match="val_dice is decimal"):
        tables.append(good.withColumn("val_dice", F.lit(1).cast("decimal(10,2)")), root, "thresholds")
    # A file of another type beside the others.
    good.withColumn("fold", F.lit("two")).write.mode("append").parquet(tables.table_path(root, "thresholds"))
    with pytest.raises(ValueError):
        tables.check_layout(spark, root, "thresholds", every_file=True)
    tables.append(good, f"{root}/other", "thresholds")
    monkeypatch.setitem(schemas.TABLES, "thresholds", schemas.TABLES["thresholds"] + ", note string")
    with pytest.raises(ValueError, match="columns"):
        tables.read_table(spark, f"{root}/other", "thresholds")
    monkeypatch.undo()
    path = tables.table_path(f"{root}/other", "thresholds") + "/" + tables.LAYOUT
    spark.createDataFrame([('{"version": 7, "columns": ""}',)], "value string").coalesce(1).write.mode("overwrite").text(path)
    with pytest.raises(ValueError, match="version 7"):
        tables.append(good, f"{root}/other", "thresholds")
    good.withColumn("fold", F.lit("two")).write.parquet(tables.table_path(f"{root}/third", "thresholds"))
    with pytest.raises(ValueError, match="fold"):
        tables.read_table(spark, f"{root}/third", "thresholds")


def test_one_signature_of_all_runs_is_cut_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(queries, "TILE", 4)
    runs = [(f"r{k:02d}", "baseline" if k % 3 == 0 else f"v{k % 3}", k % 2 == 0, "d", "t") for k in range(40)]
    t = {
        "runs": spark.createDataFrame(runs, "run_id string, variant string, is_reported boolean, data_hash string, finished_at string"),
        "fold_assignments": spark.createDataFrame([(r[0], 1, "i1", "test") for r in runs], "run_id string, fold int, image_id string, role string"),
    }
    got = queries.paired_runs(t).select("baseline_run_id", "other_run_id").collect()
    want = {(a[0], b[0]) for a in runs for b in runs if a[1] == "baseline" != b[1]}
    assert len(got) == len(want) and set(map(tuple, got)) == want
    tiles = queries._paired(t).groupBy("baseline_run_id", "_tile").count().collect()
    assert max(r["count"] for r in tiles) < len(runs) / 2


def test_draws_of_the_bootstrap_do_not_pass_through_the_driver(spark):
    rows = [(f"r{k % 2}", f"i{k}", float(k % 7)) for k in range(60)]
    out = stats.bootstrap_mean_ci(spark.createDataFrame(rows, "g string, image_id string, value double"), ["g"], "image_id", 300, 1, 0.9)
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in final]
    for i, line in enumerate(final):
        if "BroadcastExchange" in line:
            below = next((j for j in range(i + 1, len(final)) if depth[j] <= depth[i]), len(final))
            assert not any("MapInArrow" in x for x in final[i + 1 : below])


def test_exploded_pixels_are_not_broadcast(spark):
    numbers = F.explode(F.sequence(F.lit(0), F.lit(999)))
    pixels = spark.range(20).select((F.col("id") % 2).alias("fold"), F.col("id").alias("image_id"), numbers.alias("col")).select(
        "*", F.lit(0).alias("row"), (F.col("col") / 1000).cast("float").alias("prob"), (F.col("col") % 3 == 0).alias("label"),
        F.lit(True).alias("in_fov"),
    )
    chosen = spark.createDataFrame([(0, 0.25), (1, 0.5)], "fold bigint, threshold double")
    judged = ranking.salted_lookup(pixels, chosen, ["fold"], ["image_id", "col"])
    out = metrics.evaluate_items(judged, ["image_id", "threshold"], F.col("threshold"))
    assert out.count() == 20
    assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()
