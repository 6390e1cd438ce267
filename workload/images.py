"""Queries over pixel images: preprocessing, distances, skeletons, patches and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskaudit.functions import draws
from maskaudit.functions import scalars as S
from maskaudit.operators import equalize, folds, patches, pixels, reconcile, spatial, tiles
from workload.bindings import (
    draw_sql, grid_pixels, query, ratio_sql, rgb_pixels, sql, table, unit_sql,
)
from workload.scoring import r9

IMG = ["image_id"]


@query(
    "pixels_from_arrays",
    """SELECT vec_id, cast(pos // 8 AS integer) AS row, cast(pos % 8 AS integer) AS col, value
FROM (SELECT vec_id, unnest(range(0, 64)) AS pos, cast(unnest(embedding) AS double) AS value FROM embeddings)""",
)
def pixels_from_arrays(spark, sf):
    out = pixels.pixels_from_arrays(table(spark, sf, "embeddings"), ["vec_id"], "embedding", F.lit(8))
    return out.withColumn("value", F.col("value").cast("double"))


@query(
    "image_record",
    sql(
        f"""SELECT image_id, count(*) FILTER (in_fov) AS fov_pixels,
  CASE WHEN image_id % 4 <> 0 THEN count(*) FILTER (label AND in_fov) END AS positive_pixels,
  CASE WHEN image_id % 4 <> 0 THEN {ratio_sql('count(*) FILTER (label AND in_fov)', 'count(*) FILTER (in_fov)')} END
    AS vessel_fraction_in_fov,
  image_id % 4 <> 0 AS has_labels FROM grid_pixels GROUP BY image_id""",
        "grid_pixels",
    ),
)
def image_record(spark, sf):
    """Every fourth image withholds its labels."""
    p = grid_pixels(spark, sf).withColumn("label", F.when(F.col("image_id") % 4 != 0, F.col("label")))
    return pixels.image_record(p, IMG)


@query(
    "mask_domain_violations",
    sql(
        """SELECT image_id, string_agg(cast(v AS varchar), ',' ORDER BY v) AS found FROM (
  SELECT DISTINCT image_id, CASE WHEN in_fov THEN 255 WHEN r % 9 = 0 THEN r ELSE 0 END AS v FROM rgb_pixels)
WHERE v NOT IN (0, 255) GROUP BY image_id""",
        "rgb_pixels",
    ),
)
def mask_domain_violations(spark, sf):
    v = F.when(F.col("in_fov"), 255).when(F.col("r") % 9 == 0, F.col("r")).otherwise(0)
    return reconcile.mask_domain_violations(rgb_pixels(spark, sf).withColumn("v", v), IMG, "v")


@query(
    "channel_select",
    sql("SELECT image_id, row, col, CASE WHEN in_fov THEN g ELSE 0 END AS v FROM rgb_pixels", "rgb_pixels"),
)
def channel_select(spark, sf):
    return pixels.channel(rgb_pixels(spark, sf)).select("image_id", "row", "col", "v")


GRAY_SQL = "cast(floor(0.299::double * r + 0.587::double * g + 0.114::double * b + 0.5::double) AS integer)"


@query(
    "grayscale",
    sql(f"SELECT image_id, row, col, CASE WHEN in_fov THEN {GRAY_SQL} ELSE 0 END AS v FROM rgb_pixels", "rgb_pixels"),
)
def grayscale(spark, sf):
    return pixels.channel(rgb_pixels(spark, sf), green=False).select("image_id", "row", "col", "v")


@query(
    "standardize_in_mask",
    sql(
        """SELECT image_id, row, col, round(CASE WHEN in_fov THEN (x - m) / s ELSE 0 END, 9) AS z
FROM grid_pixels JOIN (SELECT image_id, avg(x) AS m, stddev_pop(x) AS s FROM grid_pixels WHERE in_fov GROUP BY 1)
USING (image_id)""",
        "grid_pixels",
    ),
)
def standardize_in_mask(spark, sf):
    out = pixels.standardize_in_mask(grid_pixels(spark, sf), IMG, "x")
    return r9(out.select("image_id", "row", "col", "z"), "z")


FLAT = "CASE WHEN image_id % 9 = 0 THEN 7 WHEN in_fov THEN g ELSE 0 END"


@query(
    "constant_masks",
    sql(f"SELECT image_id FROM (SELECT *, {FLAT} AS v FROM rgb_pixels) WHERE in_fov GROUP BY image_id HAVING min(v) = max(v)", "rgb_pixels"),
)
def constant_masks(spark, sf):
    """Images that cannot be standardised; every ninth has lost its channel."""
    return pixels.constant_masks(rgb_pixels(spark, sf).withColumn("v", F.expr(FLAT)), IMG, "v")


# ---------------------------------------------------------------- equalisation, 3 x 2 tiles of 8 x 8 images
# Rows pad from 8 to 9 (three tiles of 3); columns pad from 8 to 10 (two tiles of 5), as the pair
# does not divide evenly.

HIST = """chan AS MATERIALIZED (SELECT image_id, row, col, CASE WHEN in_fov THEN g ELSE 0 END AS v FROM rgb_pixels),
tall AS (SELECT image_id, v, col, unnest(CASE WHEN row = 6 THEN [6, 8] ELSE [row] END) AS r FROM chan),
padded AS (SELECT image_id, v, r, unnest(CASE WHEN col IN (5, 6) THEN [col, 14 - col] ELSE [col] END) AS c FROM tall),
counted AS MATERIALIZED (SELECT image_id, r // 3 AS tile_row, c // 5 AS tile_col, v AS level, count(*) AS n FROM padded GROUP BY ALL),
tiles AS (SELECT DISTINCT image_id, tile_row, tile_col FROM counted),
hist AS MATERIALIZED (SELECT image_id, tile_row, tile_col, cast(level AS integer) AS level, coalesce(n, 0) AS n
  FROM (SELECT *, unnest(range(0, 256)) AS level FROM tiles) LEFT JOIN counted USING (image_id, tile_row, tile_col, level)),
excess AS (SELECT *, sum(greatest(n - 1, 0)) OVER (PARTITION BY image_id, tile_row, tile_col) AS e FROM hist),
clipped AS (SELECT image_id, tile_row, tile_col, level, cast(least(n, 1) + e // 256
  + CASE WHEN e % 256 > 0 AND level % (256 // (e % 256)) = 0 AND level // (256 // (e % 256)) < e % 256
    THEN 1 ELSE 0 END AS bigint) AS clipped FROM excess),
luts AS MATERIALIZED (SELECT *, cast(least(greatest(round_even(cast(cast(sum(clipped) OVER (
    PARTITION BY image_id, tile_row, tile_col ORDER BY level) AS float)
    * cast(255.0::float / 15.0::float AS float) AS double), 0), 0), 255) AS integer) AS lut FROM clipped)"""


def _tail(base: str, extra: str, body: str) -> str:
    return sql("", base).rstrip() + ",\n" + extra + "\n" + body


BLEND = """places AS (SELECT *, cast(cast(row AS float) * cast(1.0::float / 3.0::float AS float) - 0.5::float AS float) AS fy,
  cast(cast(col AS float) * cast(1.0::float / 5.0::float AS float) - 0.5::float AS float) AS fx FROM chan),
cells AS (SELECT image_id, row, col, v, cast(floor(fy) AS integer) AS y, cast(floor(fx) AS integer) AS x,
  cast(fy - cast(floor(fy) AS float) AS float) AS ya, cast(fx - cast(floor(fx) AS float) AS float) AS xa FROM places),
eq AS (SELECT c.image_id, c.row, c.col, cast(least(greatest(round_even(cast(
    cast(cast(a.lut * (1.0::float - xa) + b.lut * xa AS float) * (1.0::float - ya)
       + cast(d.lut * (1.0::float - xa) + e.lut * xa AS float) * ya AS float) AS double), 0), 0), 255) AS integer) AS v
  FROM cells c
  JOIN luts a ON a.image_id = c.image_id AND a.level = v AND a.tile_row = greatest(y, 0) AND a.tile_col = greatest(x, 0)
  JOIN luts b ON b.image_id = c.image_id AND b.level = v AND b.tile_row = greatest(y, 0) AND b.tile_col = least(x + 1, 1)
  JOIN luts d ON d.image_id = c.image_id AND d.level = v AND d.tile_row = least(y + 1, 2) AND d.tile_col = greatest(x, 0)
  JOIN luts e ON e.image_id = c.image_id AND e.level = v AND e.tile_row = least(y + 1, 2) AND e.tile_col = least(x + 1, 1))"""


@query(
    "tile_lookup",
    _tail("rgb_pixels", HIST, "SELECT image_id, tile_row, tile_col, level, clipped, lut FROM luts"),
)
def tile_lookup(spark, sf):
    p = pixels.channel(rgb_pixels(spark, sf))
    shape = equalize.image_shape(p, IMG, (3, 2))
    tables = equalize.tile_tables(equalize.in_blocks(p, shape, IMG), shape, IMG, "v", 2.0, (3, 2))
    return equalize.lut_rows(tables, IMG)


@query("tile_equalize", _tail("rgb_pixels", HIST + ",\n" + BLEND, "SELECT image_id, row, col, v FROM eq"))
def tile_equalize(spark, sf):
    p = pixels.channel(rgb_pixels(spark, sf))
    return equalize.equalize(p, IMG, "v", 2.0, (3, 2)).select("image_id", "row", "col", "v")


@query(
    "preprocess",
    _tail(
        "rgb_pixels",
        HIST + ",\n" + BLEND + """,
unit AS (SELECT e.image_id, e.row, e.col, p.in_fov, cast(e.v AS double) / 255.0::double AS x
  FROM eq e JOIN rgb_pixels p ON p.image_id = e.image_id AND p.row = e.row AND p.col = e.col),
stats AS (SELECT image_id, avg(x) AS m, stddev_pop(x) AS s FROM unit WHERE in_fov GROUP BY image_id)""",
        """SELECT image_id, row, col, round(CASE WHEN in_fov THEN (x - m) / s ELSE 0 END, 9) AS x
FROM unit JOIN stats USING (image_id)""",
    ),
)
def preprocess(spark, sf):
    out = pixels.preprocess(rgb_pixels(spark, sf), IMG, tile_grid=(3, 2))
    return r9(out.select("image_id", "row", "col", "x"), "x")


# ---------------------------------------------------------------- distances and skeletons

VESSEL = "vessel AS (SELECT image_id, fold, row, col, prob, label AND in_fov AS fg FROM grid_pixels)"
DISTANCE = """d2 AS (SELECT a.image_id, a.row, a.col, cast(least(
    min(CASE WHEN b.fg THEN NULL ELSE (a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col) END),
    pow(least(a.row + 1, 8 - a.row, a.col + 1, 8 - a.col), 2)) AS bigint) AS d2
  FROM vessel a JOIN vessel b ON a.image_id = b.image_id WHERE a.fg GROUP BY a.image_id, a.row, a.col)"""


@query("distance_transform", _tail("grid_pixels", VESSEL + ",\n" + DISTANCE, "SELECT * FROM d2"))
def distance_transform(spark, sf):
    return spatial.squared_distance(grid_pixels(spark, sf), IMG)


def thinning_sql(passes: int) -> str:
    """Unrolled thinning of small images: each step reads the neighbours with window functions."""
    parts, previous = ["t0 AS MATERIALIZED (SELECT image_id, row, col, cast(fg AS integer) AS v FROM vessel)"], "t0"
    for i in range(1, 2 * passes + 1):
        line = "OVER (PARTITION BY image_id, row ORDER BY col)"
        side = "OVER (PARTITION BY image_id, col ORDER BY row)"
        parts.append(
            f"h{i} AS (SELECT *, coalesce(lag(v) {line}, 0) AS w, coalesce(lead(v) {line}, 0) AS e FROM {previous})"
        )
        cells = ", ".join(
            f"coalesce({fn}({src}) {side}, 0) AS {name}"
            for fn, prefix in (("lag", "n"), ("lead", "s"))
            for src, name in (("v", prefix), ("w", prefix + "w"), ("e", prefix + "e"))
        )
        parts.append(f"g{i} AS (SELECT *, {cells} FROM h{i})")
        ring = ["n", "ne", "e", "se", "s", "sw", "w", "nw"]
        count = " + ".join(ring)
        changes = " + ".join(
            f"(CASE WHEN {a} = 0 AND {b} = 1 THEN 1 ELSE 0 END)" for a, b in zip(ring, ring[1:] + ring[:1])
        )
        gates = "n * e * s = 0 AND e * s * w = 0" if i % 2 else "n * e * w = 0 AND n * s * w = 0"
        parts.append(
            f"t{i} AS MATERIALIZED (SELECT image_id, row, col, CASE WHEN v = 1 AND {count} BETWEEN 2 AND 6 "
            f"AND {changes} = 1 AND {gates} THEN 0 ELSE v END AS v FROM g{i})"
        )
        previous = f"t{i}"
    parts.append(f"skel AS (SELECT image_id, row, col FROM {previous} WHERE v = 1)")
    return ",\n".join(parts)


# Eight passes settle any 8 x 8 image.
SKELETON = VESSEL + ",\n" + thinning_sql(8)


@query("skeleton", _tail("grid_pixels", SKELETON, "SELECT image_id, row, col FROM skel"))
def skeleton(spark, sf):
    return spatial.skeleton(grid_pixels(spark, sf), IMG)


RADII = SKELETON + ",\n" + DISTANCE + """,
radii AS (SELECT s.image_id, s.row, s.col, d2 FROM skel s JOIN d2 USING (image_id, row, col))"""


@query(
    "skeleton_radius",
    _tail("grid_pixels", RADII, "SELECT image_id, row, col, d2, sqrt(cast(d2 AS double)) AS radius FROM radii"),
)
def skeleton_radius(spark, sf):
    return spatial.skeleton_radius(grid_pixels(spark, sf), IMG)


# A fold's edge comes from the images the fold does not test.
EDGES = RADII + """,
edges AS (SELECT cast(f.fold AS integer) AS fold, cast(quantile_disc(d2, 0.5) AS bigint) AS edge_d2
  FROM radii, range(1, 6) f(fold) WHERE image_id % 5 + 1 <> f.fold GROUP BY f.fold)"""


def tuning_edges(radii):
    """Edge per fold over the skeletons of its training and validation images."""
    per_fold = radii.groupBy((F.col("image_id") % 5 + 1).alias("_test"), "d2").agg(F.count("*").alias("_n"))
    tuning = per_fold.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(5)))).where("fold <> _test")
    # Counts per distinct distance: repeated rows of the same distance keep the pooled quantile.
    rows = tuning.groupBy("fold", "d2").agg(F.sum("_n").alias("_n"))
    return spatial.thin_edge_of_counts(rows, ["fold"], 0.5)


@query(
    "thin_edge",
    _tail("grid_pixels", EDGES, "SELECT fold, edge_d2, sqrt(cast(edge_d2 AS double)) AS thin_edge FROM edges"),
)
def thin_edge(spark, sf):
    return tuning_edges(spatial.skeleton_radius(grid_pixels(spark, sf), IMG))


WIDTHS = EDGES + f""",
hits AS (SELECT r.image_id, v.fold, r.d2, e.edge_d2, cast(v.prob AS double) >= 0.5::double AS hit
  FROM radii r JOIN vessel v USING (image_id, row, col) JOIN edges e ON e.fold = v.fold),
per_image AS (SELECT image_id, fold,
  {ratio_sql('count(*) FILTER (hit AND d2 <= edge_d2)', 'count(*) FILTER (d2 <= edge_d2)')} AS thin_sensitivity,
  {ratio_sql('count(*) FILTER (hit AND d2 > edge_d2)', 'count(*) FILTER (d2 > edge_d2)')} AS thick_sensitivity,
  count(*) FILTER (d2 <= edge_d2) AS n_thin, count(*) FILTER (d2 > edge_d2) AS n_thick
  FROM hits GROUP BY ALL),
widths AS (SELECT i.image_id, i.fold, thin_sensitivity, thick_sensitivity, coalesce(n_thin, 0) AS n_thin,
  coalesce(n_thick, 0) AS n_thick FROM (SELECT DISTINCT image_id, fold FROM vessel) i
  LEFT JOIN per_image p ON p.image_id = i.image_id)"""


def grid_widths(spark, sf):
    """(widths per image, edges per fold) of the grid images."""
    p = grid_pixels(spark, sf)
    radii = spatial.skeleton_radius(p, IMG)
    edges = tuning_edges(radii)
    hits = radii.join(p.select("image_id", "fold", "row", "col", "prob"), ["image_id", "row", "col"])
    hits = hits.withColumn("predicted", S.is_positive(F.col("prob"), F.lit(0.5)))
    widths = spatial.width_sensitivity(hits, edges, ["image_id", "fold"], ["fold"])
    items = p.select("image_id", "fold").distinct()
    return spatial.with_items_without_skeleton(widths, items, ["image_id", "fold"]), edges


@query("width_sensitivity", _tail("grid_pixels", WIDTHS, "SELECT * FROM widths"))
def width_sensitivity(spark, sf):
    return grid_widths(spark, sf)[0]


@query(
    "fold_width_totals",
    _tail(
        "grid_pixels", WIDTHS,
        "SELECT fold, cast(sum(n_thin) AS bigint) AS n_thin, cast(sum(n_thick) AS bigint) AS n_thick FROM widths GROUP BY fold",
    ),
)
def fold_width_totals(spark, sf):
    return spatial.fold_width_totals(grid_widths(spark, sf)[0], ["fold"])


@query(
    "edge_consistency",
    _tail(
        "grid_pixels",
        RADII + """,
texts AS (SELECT image_id % 10 AS run_id, fold, printf('%.3f', sqrt(cast(quantile_disc(d2, 0.5) AS double))) AS t
  FROM radii JOIN vessel USING (image_id, row, col) GROUP BY ALL)""",
        """SELECT run_id, string_agg(DISTINCT t, ', ' ORDER BY t) AS edges, count(DISTINCT t) AS n_edges
FROM texts GROUP BY run_id""",
    ),
)
def edge_consistency(spark, sf):
    """Ten groups of images stand in for runs."""
    from maskaudit.plans.reports import edge_consistency as consistency

    radii = spatial.skeleton_radius(grid_pixels(spark, sf), IMG).select(
        (F.col("image_id") % 10).alias("run_id"), (F.col("image_id") % 5 + 1).alias("fold"), "d2"
    )
    return consistency(spatial.thin_edge(radii, ["run_id", "fold"], 0.5))


# ---------------------------------------------------------------- patches

N_PATCHES = 4000
SIZE = 6
SEED = 11
CENTERS = f"""fov AS (SELECT image_id, count(*) AS fov FROM grid_pixels WHERE in_fov GROUP BY image_id),
listed AS (SELECT image_id, fov, row_number() OVER (ORDER BY {draw_sql(SEED, 'image order', 'image_id')}, image_id) - 1 AS i
  FROM fov),
ranked AS (SELECT image_id, row, col, row_number() OVER (PARTITION BY image_id ORDER BY row, col) - 1 AS pick
  FROM grid_pixels WHERE in_fov),
picked AS (SELECT p.id AS patch_id, l.image_id, {draw_sql(SEED, 'pixel', 'p.id')} % l.fov AS pick
  FROM range(0, {N_PATCHES}) p(id) JOIN listed l ON l.i = {draw_sql(SEED, 'image', 'p.id')} % (SELECT count(*) FROM fov)),
centers AS (SELECT patch_id, image_id, row, col FROM picked JOIN ranked USING (image_id, pick))"""


@query("sample_centers", _tail("grid_pixels", CENTERS, "SELECT * FROM centers"))
def sample_centers(spark, sf):
    return patches.sample_centers(grid_pixels(spark, sf), "image_id", N_PATCHES, SEED)


AUGMENTED = CENTERS + f""",
aug AS (SELECT *, {unit_sql(SEED, 'flip_rows', 'patch_id')} < 0.5::double AS flip_rows,
  {unit_sql(SEED, 'flip_cols', 'patch_id')} < 0.5::double AS flip_cols,
  cast({draw_sql(SEED, 'rotations', 'patch_id')} % 4 AS integer) AS rotations,
  -0.1::double + {unit_sql(SEED, 'brightness', 'patch_id')} * 0.2::double AS brightness,
  0.9::double + {unit_sql(SEED, 'contrast', 'patch_id')} * {1.1 - 0.9!r}::double AS contrast FROM centers)"""


@query(
    "augmentation_draws",
    _tail(
        "grid_pixels", AUGMENTED,
        "SELECT * REPLACE (round(brightness, 9) AS brightness, round(contrast, 9) AS contrast) FROM aug",
    ),
)
def augmentation_draws(spark, sf):
    return r9(patches.sample_augmentation(sample_centers(spark, sf), SEED), "brightness", "contrast")


CROPPED = AUGMENTED + f""",
cropped AS (SELECT a.patch_id, a.image_id, flip_rows, flip_cols, rotations, brightness, contrast,
  cast(pr AS integer) AS pr, cast(pc AS integer) AS pc, coalesce(g.x, 0) AS x,
  coalesce(cast(g.label AS double), 0) AS y, coalesce(cast(g.in_fov AS double), 0) AS w
  FROM aug a CROSS JOIN range(0, {SIZE}) r(pr) CROSS JOIN range(0, {SIZE}) c(pc)
  LEFT JOIN grid_pixels g ON g.image_id = a.image_id AND g.row = a.row - {SIZE // 2} + pr AND g.col = a.col - {SIZE // 2} + pc)"""


@query("patch_crop", _tail("grid_pixels", CROPPED, "SELECT patch_id, image_id, pr, pc, x, y, w FROM cropped"))
def patch_crop(spark, sf):
    return patches.crop(sample_centers(spark, sf), grid_pixels(spark, sf), "image_id", "x", SIZE)


MOVED = CROPPED + f""",
flipped AS (SELECT * REPLACE (CASE WHEN flip_rows THEN {SIZE - 1} - pr ELSE pr END AS pr,
  CASE WHEN flip_cols THEN {SIZE - 1} - pc ELSE pc END AS pc) FROM cropped),
moved AS (SELECT * REPLACE (
  cast(CASE rotations WHEN 1 THEN {SIZE - 1} - pc WHEN 2 THEN {SIZE - 1} - pr WHEN 3 THEN pc ELSE pr END AS integer) AS pr,
  cast(CASE rotations WHEN 1 THEN pr WHEN 2 THEN {SIZE - 1} - pc WHEN 3 THEN {SIZE - 1} - pr ELSE pc END AS integer) AS pc)
  FROM flipped),
jittered AS (SELECT patch_id, pr, pc, y, w, (x * contrast + (1.0::double - contrast)
  * (sum(x * w) OVER (PARTITION BY patch_id) / greatest(sum(w) OVER (PARTITION BY patch_id), 1.0::double))
  + brightness) * w AS x FROM moved)"""


def _augmented_crops(spark, sf):
    names = ("flip_rows", "flip_cols", "rotations", "brightness", "contrast")
    centers = patches.sample_augmentation(sample_centers(spark, sf), SEED)
    crops = patches.crop(centers, grid_pixels(spark, sf), "image_id", "x", SIZE, names)
    return patches.augment_geometry(crops, SIZE)


@query("patch_augment_geometry", _tail("grid_pixels", MOVED, "SELECT patch_id, image_id, pr, pc, x, y, w FROM moved"))
def patch_augment_geometry(spark, sf):
    return _augmented_crops(spark, sf).select("patch_id", "image_id", "pr", "pc", "x", "y", "w")


@query(
    "patch_jitter",
    _tail("grid_pixels", MOVED, "SELECT patch_id, pr, pc, round(x, 9) AS x, y, w FROM jittered"),
)
def patch_jitter(spark, sf):
    return r9(patches.jitter(_augmented_crops(spark, sf)).select("patch_id", "pr", "pc", "x", "y", "w"), "x")


@query(
    "patch_batches",
    _tail(
        "grid_pixels", MOVED,
        """SELECT patch_id // 32 AS batch_id, cast(patch_id % 32 AS integer) AS slot, patch_id,
  string_agg(cast(cast(floor(x * 1e6::double) AS bigint) AS varchar), ',' ORDER BY pr, pc) AS x,
  string_agg(cast(cast(y AS integer) AS varchar), ',' ORDER BY pr, pc) AS y,
  string_agg(cast(cast(w AS integer) AS varchar), ',' ORDER BY pr, pc) AS w FROM jittered GROUP BY patch_id""",
    ),
)
def patch_batches(spark, sf):
    """Arrays are shown as text, x in millionths."""
    out = patches.batches(patches.jitter(_augmented_crops(spark, sf)), 32)
    micro = F.transform("x", lambda v: F.floor(v * F.lit(1e6)).cast("bigint").cast("string"))
    flag = {c: F.array_join(F.transform(c, lambda v: v.cast("int").cast("string")), ",") for c in ("y", "w")}
    return out.withColumns({"x": F.array_join(micro, ","), **flag})


# ---------------------------------------------------------------- windows

WINDOW, STRIDE = 5, 2
LAST = "cast(greatest(ceil((8 - 5) / 2.0::double), 0) AS bigint)"
TILES = f"""tiles AS (SELECT image_id, cast(a.wr AS bigint) AS wr, cast(b.wc AS bigint) AS wc,
  cast(row - a.wr * 2 AS integer) AS r, cast(col - b.wc * 2 AS integer) AS c, x
  FROM grid_pixels CROSS JOIN range(0, {LAST} + 1) a(wr) CROSS JOIN range(0, {LAST} + 1) b(wc)
  WHERE row BETWEEN a.wr * 2 AND a.wr * 2 + 4 AND col BETWEEN b.wc * 2 AND b.wc * 2 + 4)"""


@query(
    "window_starts",
    """SELECT o_orderkey, cast(i * 40000 AS bigint) AS start FROM orders,
  range(0, 30) t(i) WHERE i <= greatest(ceil((floor(o_totalprice) - 90000) / 40000.0::double), 0)""",
)
def window_starts(spark, sf):
    """Windows of 90,000 with stride 40,000 over the whole part of each order's price."""
    o = table(spark, sf, "orders").select("o_orderkey", F.floor("o_totalprice").alias("length"))
    return tiles.window_starts(o, "length", 90_000, 40_000).drop("length")


@query("tile_windows", _tail("grid_pixels", TILES, "SELECT * FROM tiles"))
def tile_windows(spark, sf):
    return tiles.tile_windows(grid_pixels(spark, sf), IMG, "x", WINDOW, STRIDE)


def affine_scorer():
    """A stand-in model, 0.5 + x / 4, exact in float32 halves and quarters."""
    return lambda batch: batch * 0.25 + 0.5


SCORED_TILES = TILES + """,
scores AS (SELECT i.image_id, cast(a.wr AS bigint) AS wr, cast(b.wc AS bigint) AS wc, cast(r.r * 5 + c.c AS integer) AS k,
  cast(cast(coalesce(t.x, 0) AS float) * 0.25::float + 0.5::float AS float) AS s
  FROM (SELECT DISTINCT image_id FROM grid_pixels) i CROSS JOIN range(0, 3) a(wr) CROSS JOIN range(0, 3) b(wc)
  CROSS JOIN range(0, 5) r(r) CROSS JOIN range(0, 5) c(c)
  LEFT JOIN tiles t ON t.image_id = i.image_id AND t.wr = a.wr AND t.wc = b.wc AND t.r = r.r AND t.c = c.c)"""


def _scored_windows(spark, sf):
    cut = tiles.tile_windows(grid_pixels(spark, sf), IMG, "x", WINDOW, STRIDE)
    return tiles.score_windows(tiles.window_arrays(cut, IMG, "x", WINDOW), WINDOW, affine_scorer)


@query("score_windows", _tail("grid_pixels", SCORED_TILES, "SELECT image_id, wr, wc, k, cast(s AS double) AS s FROM scores"))
def score_windows(spark, sf):
    return _scored_windows(spark, sf).select(
        "image_id", "wr", "wc", F.posexplode("score").alias("k", "s")
    ).withColumn("s", F.col("s").cast("double"))


STITCHED = SCORED_TILES + """,
stitched AS (SELECT image_id, row, col, round(cast(CASE WHEN g.in_fov THEN m ELSE 0 END AS float)::double, 6) AS prob
  FROM grid_pixels g JOIN (SELECT image_id, cast(wr * 2 + k // 5 AS integer) AS row, cast(wc * 2 + k % 5 AS integer) AS col,
    avg(cast(s AS double)) AS m FROM scores GROUP BY ALL) USING (image_id, row, col))"""


@query("stitch_windows", _tail("grid_pixels", STITCHED, "SELECT * FROM stitched"))
def stitch_windows(spark, sf):
    out = tiles.stitch_windows(_scored_windows(spark, sf), grid_pixels(spark, sf), IMG, WINDOW, STRIDE)
    return out.withColumn("prob", F.round(F.col("prob").cast("double"), 6))


@query(
    "predict_images",
    sql(
        """SELECT image_id, row, col, round(cast(CASE WHEN in_fov THEN cast(x AS float) * 0.25::float + 0.5::float
  ELSE 0 END AS float)::double, 6) AS prob FROM grid_pixels""",
        "grid_pixels",
    ),
)
def predict_images(spark, sf):
    out = tiles.predict_images(grid_pixels(spark, sf), IMG, "x", WINDOW, STRIDE, affine_scorer)
    return out.withColumn("prob", F.round(F.col("prob").cast("double"), 6))


# ---------------------------------------------------------------- folds over customers

FOLD_SEED = 7
ROLES = f"""ids AS (SELECT c_custkey, c_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'
  ORDER BY c_custkey LIMIT 5) AS is_spread FROM customer),
fold_order AS (SELECT cast(f AS integer) AS fold, row_number() OVER (ORDER BY {draw_sql(FOLD_SEED, 'fold', 'f')}, f) AS place
  FROM range(1, 11) t(f)),
spread AS (SELECT c_custkey, row_number() OVER (ORDER BY {draw_sql(FOLD_SEED, 'spread', 'c_custkey')}, c_custkey) AS place
  FROM ids WHERE is_spread),
spread_home AS (SELECT c_custkey, fold FROM spread JOIN fold_order USING (place)),
need AS (SELECT f.fold, (SELECT count(*) FROM ids) // 10 - count(s.fold) AS n
  FROM fold_order f LEFT JOIN spread_home s ON s.fold = f.fold GROUP BY f.fold),
slots AS (SELECT fold, n, sum(n) OVER (ORDER BY fold) - n AS first FROM need),
others AS (SELECT c_custkey, row_number() OVER (ORDER BY {draw_sql(FOLD_SEED, 'other', 'c_custkey')}, c_custkey) - 1 AS r
  FROM ids WHERE NOT is_spread),
tested AS (SELECT c_custkey, fold AS test_fold FROM spread_home
  UNION ALL SELECT c_custkey, fold FROM others JOIN slots ON r >= first AND r < first + n),
rest AS (SELECT f.fold, c_custkey, row_number() OVER (PARTITION BY f.fold
    ORDER BY {draw_sql(FOLD_SEED, 'val', 'f.fold', 'c_custkey')}, c_custkey) AS r
  FROM tested, fold_order f WHERE f.fold <> test_fold),
roles AS (SELECT fold, c_custkey, CASE WHEN r <= 20 THEN 'val' ELSE 'train' END AS role FROM rest
  UNION ALL SELECT test_fold, c_custkey, 'test' FROM tested)"""


def customer_folds(spark, sf, seed: int = FOLD_SEED):
    c = table(spark, sf, "customer")
    first = c.where("c_mktsegment = 'BUILDING'").orderBy("c_custkey").limit(5).select("c_custkey")
    spread = [r[0] for r in first.collect()]
    return folds.make_folds(c, "c_custkey", spread, 10, 20, seed)


@query("make_folds", f"WITH {ROLES}\nSELECT c_custkey, test_fold FROM tested")
def make_folds(spark, sf):
    out = customer_folds(spark, sf).where("role = 'test'")
    return out.select("c_custkey", F.col("fold").alias("test_fold"))


@query("fold_rows", f"WITH {ROLES}\nSELECT * FROM roles")
def fold_rows(spark, sf):
    return customer_folds(spark, sf)


@query("fold_role_counts", f"WITH {ROLES}\nSELECT fold, role, count(*) AS n FROM roles GROUP BY fold, role")
def fold_role_counts(spark, sf):
    return folds.fold_role_counts(customer_folds(spark, sf))


CHANGED = "CASE WHEN c_custkey % 50 = 0 AND role = 'val' THEN 'train' ELSE role END"


@query(
    "fold_rows_diff",
    f"""WITH {ROLES}, changed AS (SELECT fold, c_custkey, {CHANGED} AS role FROM roles)
SELECT *, 'stored only' AS side FROM (SELECT fold, c_custkey, role FROM roles EXCEPT ALL SELECT * FROM changed)
UNION ALL SELECT *, 'computed only' FROM (SELECT * FROM changed EXCEPT ALL SELECT fold, c_custkey, role FROM roles)""",
)
def fold_rows_diff(spark, sf):
    stored = customer_folds(spark, sf)
    moved = F.when((F.col("c_custkey") % 50 == 0) & (F.col("role") == "val"), "train").otherwise(F.col("role"))
    return folds.fold_rows_diff(stored, stored.withColumn("role", moved), ["fold", "c_custkey", "role"])


@query(
    "fold_set_difference",
    f"""WITH {ROLES}, changed AS (SELECT fold, c_custkey, {CHANGED} AS role FROM roles)
SELECT fold, c_custkey, role FROM roles EXCEPT SELECT fold, c_custkey, role FROM changed""",
)
def fold_set_difference(spark, sf):
    stored = customer_folds(spark, sf)
    moved = F.when((F.col("c_custkey") % 50 == 0) & (F.col("role") == "val"), "train").otherwise(F.col("role"))
    return stored.select("fold", "c_custkey", "role").subtract(
        stored.select("fold", "c_custkey", moved.alias("role"))
    )


@query(
    "derived_seed",
    """SELECT o_orderkey, cast('0x' || substr(md5(concat_ws('|', '7', 'seed', cast(o_custkey % 5 + 1 AS varchar),
  cast(o_orderkey AS varchar))), 1, 8) AS bigint) AS seed FROM orders""",
)
def derived_seed(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(
        "o_orderkey", draws.derived_seed(7, F.col("o_custkey") % 5 + 1, F.col("o_orderkey")).alias("seed")
    )
