"""Exact distances, centrelines and recall by vessel width.

All operators read the long pixel table (``row``, ``col``, ``label``, ``in_fov``); a pixel is a
vessel when it is labelled and inside the mask, and everything beyond the image is background.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskaudit.functions import scalars as S
from maskaudit.operators.ranking import null_safe_join, salted_lookup
from maskaudit.session import Rounds

BLOCK = 128
PASSES = 16
STACK = 1 << 22  # cells of blocks that are thinned together
ENVELOPE = 1 << 18  # cells of stretches of lines that are scanned together
PART = 1 << 16  # rows of one batch of distances
CELLS = 1 << 18  # cells of blocks or lines that are worked on together, whatever the size of a batch


def vessel() -> Column:
    return F.coalesce(F.col("label") & F.col("in_fov"), F.lit(False))


def _pieces(sizes: np.ndarray, cells: int = CELLS) -> Iterator[tuple[int, int]]:
    """Cut rows of ``sizes`` cells into runs of about ``cells`` cells, a longer row by itself."""
    ends, begin = np.cumsum(sizes), 0
    while begin < len(ends):
        before = ends[begin - 1] if begin else 0
        end = max(int(np.searchsorted(ends, before + cells, side="right")), begin + 1)
        yield begin, end
        begin = end


def squared_distance(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Integer squared distance of each vessel pixel to the nearest background.

    Only vessel pixels move: what is not in the table is background, as is everything beyond the image, so a line of an
    image is the stretches of vessel pixels in it. In an image column the ends of its stretch give a pixel's vertical
    distance. In an image row, the nearest background of a stretch of pixels is the lower envelope of one parabola per
    pixel, found in one scan there and one back: steps grow with the pixels, not with the width of vessels. Neither pass
    holds more than one line of an image at a time.
    """
    column = Window.partitionBy(*keys, "col").orderBy("row")
    stretch = Window.partitionBy(*keys, "col", "_stretch")
    vertical = (
        pixels.where(vessel())
        .select(*keys, "row", "col", (F.col("row") - F.row_number().over(column)).alias("_stretch"))
        .select(
            *keys, "row", F.col("col").cast("int").alias("col"),
            F.least(F.col("row") - F.min("row").over(stretch), F.max("row").over(stretch) - F.col("row")).cast("int").alias("_g"),
        )
    )
    lines = vertical.groupBy(*keys, "row").agg(F.collect_list("col").alias("_cols"), F.collect_list("_g").alias("_gs"))
    names = [*keys, "row"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first, last in _pieces(whole.column("_cols").value_lengths().to_numpy()):
                batch = whole.slice(first, last - first)
                sizes = batch.column("_cols").value_lengths().to_numpy().astype(np.int64)
                cols = batch.column("_cols").flatten().to_numpy().astype(np.int64)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                order = np.lexsort((cols, owner))
                d2 = _line_distances(owner, cols[order], batch.column("_gs").flatten().to_numpy()[order].astype(np.int64) + 1)
                for begin in range(0, len(d2), PART):
                    part = slice(begin, begin + PART)
                    take = pa.array(owner[part])
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(c).take(take) for c in names), pa.array(cols[order][part].astype(np.int32)), pa.array(d2[part])],
                        [*names, "col", "d2"],
                    )

    kept = ", ".join(f"`{c}` {lines.schema[c].dataType.simpleString()}" for c in names)
    return lines.mapInArrow(scan, f"{kept}, col int, d2 bigint")


def _line_distances(line: np.ndarray, cols: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Squared distances of pixels ordered by line and column, with vertical distances ``g`` of at least 1."""
    out = np.zeros(len(cols), dtype=np.int64)
    fresh = np.ones(len(cols), dtype=bool)
    fresh[1:] = (line[1:] != line[:-1]) | (cols[1:] != cols[:-1] + 1)
    first = np.flatnonzero(fresh)
    widths = np.diff(np.append(first, len(cols)))
    order = np.argsort(widths, kind="stable")
    begin = 0
    while begin < len(order):
        # Stretches of about one width side by side; background beyond a shorter one does not come nearer than its end.
        end = begin + 1
        while end < len(order) and (end + 1 - begin) * (widths[order[end]] + 2) <= ENVELOPE:
            end += 1
        chosen = order[begin:end]
        width = int(widths[chosen[-1]])
        inside = np.arange(width)[None, :] < widths[chosen][:, None]
        at = (first[chosen][:, None] + np.arange(width)[None, :])[inside]
        squares = np.zeros((len(chosen), width + 2), dtype=np.int64)
        squares[:, 1:-1][inside] = g[at] ** 2
        out[at] = _lower_envelope(squares)[:, 1:-1][inside]
        begin = end
    return out


def _lower_envelope(squares: np.ndarray) -> np.ndarray:
    """For each row and column c, the least (c - s)**2 + squares[s] over all columns s.

    All rows advance together. ``site[:, k]`` are the columns whose parabolas make up the envelope so far and
    ``since[:, k]`` the first column where each one is lowest; a new parabola drops those it undercuts, each once.
    """
    n, width = squares.shape
    every = np.arange(n)
    site, since = np.zeros((n, width), dtype=np.int64), np.zeros((n, width), dtype=np.int64)
    top = np.zeros(n, dtype=np.int64)
    for c in range(1, width):
        rows = every
        while len(rows):
            s, t = site[rows, top[rows]], since[rows, top[rows]]
            under = (t - s) ** 2 + squares[rows, s] > (t - c) ** 2 + squares[rows, c]
            rows = rows[under]
            top[rows] -= 1
            rows = rows[top[rows] >= 0]
        bare = top < 0
        top[bare] = 0
        s = site[every, top]
        crossing = 1 + (c * c - s * s + squares[:, c] - squares[every, s]) // np.maximum(2 * (c - s), 1)
        site[bare, 0] = c
        grow = every[~bare & (crossing < width)]
        top[grow] += 1
        site[grow, top[grow]] = c
        since[grow, top[grow]] = crossing[grow]
    out = np.zeros((n, width), dtype=np.int64)
    for c in range(width - 1, -1, -1):
        s = site[every, top]
        out[:, c] = (c - s) ** 2 + squares[every, s]
        top -= (since[every, top] == c) & (top > 0)
    return out


def _removable() -> np.ndarray:
    """For both half-passes, whether a pixel with a given ring of neighbours is removed.

    Bit i of a ring is the i-th neighbour clockwise from north. A pixel goes when it has two to six
    neighbours in one run, and the sides named by the half-pass are open (Zhang and Suen, 1984).
    """
    ring = (np.arange(256)[:, None] >> np.arange(8)) & 1
    count = ring.sum(axis=1)
    runs = ((ring == 0) & (np.roll(ring, -1, axis=1) == 1)).sum(axis=1)
    n, e, s, w = ring[:, 0], ring[:, 2], ring[:, 4], ring[:, 6]
    thin = (count >= 2) & (count <= 6) & (runs == 1)
    first = (n * e * s == 0) & (e * s * w == 0)
    second = (n * e * w == 0) & (n * s * w == 0)
    return np.stack([thin & first, thin & second])


REMOVABLE = _removable()
# Row and column steps to the neighbours, clockwise from north.
RING = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))


def _thin_half(masks: np.ndarray, half: int) -> np.ndarray:
    """One half-pass over a mask, or a stack of masks."""
    *stack, h, w = masks.shape
    padded = np.zeros((*stack, h + 2, w + 2), dtype=np.uint8)
    padded[..., 1:-1, 1:-1] = masks
    code = np.zeros(masks.shape, dtype=np.uint8)
    for bit, (dr, dc) in enumerate(RING):
        code |= padded[..., 1 + dr : 1 + dr + h, 1 + dc : 1 + dc + w] << bit
    return masks & ~REMOVABLE[half][code]


def _thin_stack(masks: np.ndarray, passes: int) -> tuple[np.ndarray, np.ndarray]:
    """Run ``passes`` full passes over a stack of masks; return what is left and what the last pass still removed."""
    removed = np.zeros_like(masks)
    for _ in range(passes):
        before = masks
        masks = _thin_half(_thin_half(masks, 0), 1)
        removed = before & ~masks
        if not removed.any():
            break
    return masks, removed


def _thin_blocks(blocks: Sequence[np.ndarray], side: int, halo: int, passes: int) -> tuple[list, list]:
    """Thin blocks given as cells of a ``side`` x ``side`` grid; return the cells left beyond the halo, and whether the
    last pass removed any there.

    Only the box around a block's cells is worked on, as everything beyond it is background, and boxes of about one size
    are stacked.
    """
    kept, moved = [np.zeros(0, dtype=np.int32)] * len(blocks), [False] * len(blocks)
    filled = [i for i, b in enumerate(blocks) if len(b)]
    if not filled:
        return kept, moved
    counts = np.array([len(blocks[i]) for i in filled])
    cells = np.concatenate([blocks[i] for i in filled]).astype(np.int64)
    owner = np.repeat(np.arange(len(filled)), counts)
    rows, cols = cells // side, cells % side
    first = np.cumsum(counts) - counts
    top, left = np.minimum.reduceat(rows, first), np.minimum.reduceat(cols, first)
    height = np.maximum.reduceat(rows, first) - top + 1
    width = np.maximum.reduceat(cols, first) - left + 1
    order = np.lexsort((width, height))
    begin = 0
    while begin < len(order):
        end, h, w = begin, 0, 0
        while end < len(order):
            taller, wider = max(h, height[order[end]]), max(w, width[order[end]])
            if end > begin and (end - begin + 1) * taller * wider > STACK:
                break
            end, h, w = end + 1, taller, wider
        chosen = order[begin:end]
        place = np.full(len(filled), -1)
        place[chosen] = np.arange(len(chosen))
        here = place[owner] >= 0
        masks = np.zeros((len(chosen), h, w), dtype=bool)
        masks[place[owner[here]], rows[here] - top[owner[here]], cols[here] - left[owner[here]]] = True
        for out, marked in zip((kept, moved), _thin_stack(masks, passes)):
            k, r, c = np.nonzero(marked)
            r, c = r + top[chosen[k]], c + left[chosen[k]]
            own = (r >= halo) & (r < side - halo) & (c >= halo) & (c < side - halo)
            k, found = k[own], (r * side + c)[own].astype(np.int32)
            for i, part in zip(chosen, np.split(found, np.searchsorted(k, np.arange(1, len(chosen))))):
                out[filled[i]] = part if out is kept else len(part) > 0
        begin = end
    return kept, moved


def _thinner(block: int, halo: int, passes: int):
    @F.pandas_udf("struct<left:array<int>,removed:boolean>")
    def thin(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for cells in batches:
            if not len(cells):
                yield pd.DataFrame({"left": [], "removed": []})
            for first, last in _pieces(np.array([len(c) for c in cells], dtype=np.int64)):
                left, removed = _thin_blocks(list(cells[first:last]), block + 2 * halo, halo, passes)
                yield pd.DataFrame({"left": left, "removed": removed})

    return thin


def _latest(rounds: Sequence[DataFrame], place: Sequence[str]) -> DataFrame:
    """Return every block as its last round left it."""
    out, newer = rounds[-1], rounds[-1].select(*place)
    for older in reversed(rounds[:-1]):
        out = out.unionByName(null_safe_join(older, newer, place, "left_anti"))
        newer = newer.unionByName(older.select(*place))
    return out


def _around(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The blocks and their eight neighbours."""
    ring = F.sequence(F.lit(-1), F.lit(1))
    return (
        blocks.select(*keys, "_br", "_bc", F.explode(ring).alias("_dr")).select("*", F.explode(ring).alias("_dc"))
        .select(*keys, (F.col("_br") + F.col("_dr")).alias("_br"), (F.col("_bc") + F.col("_dc")).alias("_bc"))
        .distinct()
    )


def skeleton(
    pixels: DataFrame, keys: Sequence[str], block: int = BLOCK, passes: int = PASSES
) -> DataFrame:
    """L3: the one-pixel centreline of every vessel.

    An image is cut into blocks, each with a halo of two pixels per pass: a pixel's fate after
    ``passes`` passes depends on nothing farther away, so the blocks thin independently and agree
    exactly with thinning the whole image. A task holds single blocks of fixed size, never an image, and only vessel
    pixels move.

    After the first round only a frontier is worked on: blocks whose last pass removed a pixel, and their neighbours.
    Removal travels two pixels a pass, so within a round it cannot cross a block (of at least two halos) into one whose
    neighbours were still. A round reads the frontier and the ring around it and writes the frontier; rounds end when
    no last pass removed a pixel, and their tables are then dropped for one that holds every block once.
    """
    halo = 2 * passes
    if block < 2 * halo:
        raise ValueError(f"block {block} is smaller than two halos of {halo} for {passes} passes")
    side = block + 2 * halo
    thin = _thinner(block, halo, passes)
    place = [*keys, "_br", "_bc"]
    store = Rounds(pixels.sparkSession)

    def homes(position: Column) -> Column:
        # Blocks whose halo covers the pixel: its own, and a neighbour when it is near the edge.
        first = F.floor((position - halo) / F.lit(block))
        last = F.floor((position + halo) / F.lit(block))
        return F.sequence(first, last)

    def thinned(blocks: DataFrame) -> DataFrame:
        return blocks.select(*place, thin("_cells").alias("_t")).select(
            *place, F.col("_t.left").alias("_left"), F.col("_t.removed").alias("_removed")
        )

    spread = (
        pixels.where(vessel())
        .select(*keys, "row", "col", F.explode(homes(F.col("row"))).alias("_br"))
        .withColumn("_bc", F.explode(homes(F.col("col"))))
    )
    cell = (F.col("row") - F.col("_br") * block + halo) * side + (F.col("col") - F.col("_bc") * block + halo)
    # At most side * side cells per block.
    whole = spread.groupBy(*place).agg(F.collect_list(cell.cast("int")).alias("_cells"))
    rounds = [store.put(thinned(whole).where((F.size("_left") > 0) | F.col("_removed")))]
    while not (moved := rounds[-1].where("_removed")).isEmpty():
        if len(rounds) > 8:
            rounds = [store.replace(_latest(rounds, place))]
            moved = rounds[-1].where("_removed")
        active = _around(moved, keys)
        near = null_safe_join(_latest(rounds, place), _around(active, keys), place, "left_semi")
        ring = F.sequence(F.lit(-1), F.lit(1))
        sent = (
            near.select(*place, "_left", F.explode(ring).alias("_dr")).withColumn("_dc", F.explode(ring))
            .withColumns({"_br": F.col("_br") + F.col("_dr"), "_bc": F.col("_bc") + F.col("_dc")})
        )
        row = F.transform("_left", lambda x: F.struct(
            (F.floor(x / F.lit(side)) - F.col("_dr") * block).cast("int").alias("r"),
            (x % side - F.col("_dc") * block).cast("int").alias("c"),
        ))
        seen = F.filter(row, lambda x: x["r"].between(0, side - 1) & x["c"].between(0, side - 1))
        cells = F.transform(seen, lambda x: x["r"] * side + x["c"])
        joined = (
            null_safe_join(sent, active, place, "left_semi")
            .select(*place, cells.alias("_c"), ((F.col("_dr") == 0) & (F.col("_dc") == 0)).alias("_own"))
            .groupBy(*place)
            .agg(F.flatten(F.collect_list("_c")).alias("_cells"), F.max("_own").alias("_own"))
        )
        # A block that lost all its pixels keeps a row, which hides its earlier ones.
        rounds.append(store.put(thinned(joined.where("_own"))))
    final = rounds[0] if len(rounds) == 1 else store.replace(_latest(rounds, place))
    return final.select(*place, F.explode("_left").alias("_cell")).select(
        *keys,
        (F.col("_br") * block - halo + F.floor(F.col("_cell") / F.lit(side))).cast("int").alias("row"),
        (F.col("_bc") * block - halo + F.col("_cell") % side).cast("int").alias("col"),
    )


def skeleton_radius(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every skeleton pixel with its squared and plain radius."""
    return (
        skeleton(pixels, keys)
        .hint("merge")  # one row per pixel on both sides, whatever Spark takes their sizes for
        .join(squared_distance(pixels, keys), [*keys, "row", "col"])
        .withColumn("radius", F.sqrt(F.col("d2").cast("double")))
    )


def thin_edge(radii: DataFrame, groups: Sequence[str], quantile: float) -> DataFrame:
    """The inverted-CDF quantile of skeleton radius per group, as an observed radius.

    Radii are counted per distinct squared distance first. That leaves one row per distinct value,
    at most half the image side squared, whatever the number of pixels.
    """
    if not 0 < quantile < 1:
        raise ValueError(f"quantile must lie in (0, 1), got {quantile}")
    counts = radii.groupBy(*groups, "d2").agg(F.count("*").alias("_n"))
    return thin_edge_of_counts(counts, groups, quantile)


def thin_edge_of_counts(counts: DataFrame, groups: Sequence[str], quantile: float) -> DataFrame:
    """``thin_edge`` from rows of (group, d2, _n), for folds that share most of their images."""
    whole = Window.partitionBy(*groups)
    upto = whole.orderBy("d2").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("_cum", F.sum("_n").over(upto)).withColumn(
        "_need", F.ceil(F.sum("_n").over(whole) * F.lit(quantile))
    )
    return (
        placed.where("_cum >= _need")
        .groupBy(*groups)
        .agg(F.min("d2").alias("edge_d2"))
        .withColumn("thin_edge", F.sqrt(F.col("edge_d2").cast("double")))
    )


def width_sensitivity(
    hits: DataFrame, edges: DataFrame, keys: Sequence[str], edge_keys: Sequence[str]
) -> DataFrame:
    """Recall on thin (``d2 <= edge_d2``) and thick skeleton pixels, with their counts.

    ``hits`` holds skeleton pixels with ``d2`` and the thresholded ``predicted`` flag.
    """
    thin = F.col("d2") <= F.col("edge_d2")
    hit = F.col("predicted")
    joined = salted_lookup(hits, edges.select(*edge_keys, "edge_d2"), edge_keys, ["row", "col"])
    return joined.groupBy(*keys).agg(
        S.ratio(F.count_if(hit & thin), F.count_if(thin)).alias("thin_sensitivity"),
        S.ratio(F.count_if(hit & ~thin), F.count_if(~thin)).alias("thick_sensitivity"),
        F.count_if(thin).alias("n_thin"),
        F.count_if(~thin).alias("n_thick"),
    )


def with_items_without_skeleton(widths: DataFrame, items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items without any skeleton pixel keep a row: NULL recalls and zero counts."""
    return items.join(widths, [*keys], "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_thin", "n_thick")}
    )


def fold_width_totals(widths: DataFrame, fold_keys: Sequence[str]) -> DataFrame:
    """Thin and thick skeleton pixels per fold."""
    return widths.groupBy(*fold_keys).agg(
        F.sum("n_thin").alias("n_thin"), F.sum("n_thick").alias("n_thick")
    )
