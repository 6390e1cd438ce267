"""Embedding near-duplicates: epsilon grid order join on leading principal dimensions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskaudit.llm.components import connected_components, least_reachable
from maskaudit.llm.scratch import Scratch

COSINE = 0.93
LEADING = 12  # principal dimensions that sequences are sorted and blocks are bounded by
GRID = 3  # of these, the ones whose grid cells join block bounds
BLOCK = 1024  # vectors of one block
LEAF = 64  # interval length at which the recursion compares vectors


def cleaned(vectors: DataFrame) -> DataFrame:
    """Return (vec_id, label, dim, vector: DOUBLE array scaled to a largest component of 1) of vectors that can link.

    Left out: NULL labels, ids and vectors, vectors without components, NULL, NaN or infinite components, and zero
    vectors.
    """
    values = F.transform("embedding", lambda x: x.cast("double"))
    sane = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    top = F.array_max(F.transform("vector", lambda x: F.abs(x)))
    return (
        vectors.select("vec_id", "label", values.alias("vector"))
        .where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0))
        .where(sane)
        .withColumn("_top", top)
        .where(F.col("_top") > 0)
        .select(
            F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"),
            F.size("vector").alias("dim"), F.transform("vector", lambda x: x / F.col("_top") + 0.0).alias("vector"),
        )
    )


def principal_axes(vectors: DataFrame, leading: int = LEADING) -> tuple[int, np.ndarray]:
    """Return (dim, orthonormal axes) of the most frequent vector length, from the second moments of all its vectors.

    Each task sums its outer products, Spark adds the sums up, and dim * dim numbers come to the driver. Any
    orthonormal axes are right; these skip most.
    """
    top = vectors.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not top:
        return 0, np.zeros((0, 0))
    dim = top[0]["dim"]

    def moments(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            x = _matrix(batch.column("vector"), dim)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            total += x.T @ x
        rows = pa.array(np.arange(dim, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([rows, pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    summed = (
        vectors.where(F.col("dim") == dim).select("vector").mapInArrow(moments, "i int, row array<double>")
        .select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    )
    square = np.zeros((dim, dim))
    for r in summed:
        square[r["i"], r["j"]] = r["x"]
    _, axes = np.linalg.eigh((square + square.T) / 2)
    return dim, axes[:, ::-1][:, :leading].copy()


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _project(x: np.ndarray, axes: tuple[int, np.ndarray]) -> np.ndarray:
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    return unit @ axes[1] if x.shape[1] == axes[0] else unit[:, : max(axes[1].shape[1], 1)]


def _reach(cosine: float) -> float:
    """Return the distance of unit vectors at ``cosine``, a little widened for rounding."""
    return float(np.sqrt(max(0.0, 2.0 - 2.0 * cosine))) + 1e-6


BLOCKS = (
    "block bigint, label string, dim int, size int, lo array<double>, hi array<double>, cells_lo array<int>,"
    " cells_hi array<int>, nodes binary, copies binary, vectors binary"
)


def _in_blocks(nodes: DataFrame, axes: tuple[int, np.ndarray], cosine: float) -> DataFrame:
    """Sort the nodes by label, length and grid cells, and cut the sequence into blocks with their bounds."""
    eps = _reach(cosine)

    def place(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cells = [None] * len(dims)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                p = _project(_matrix(batch.column("vector").take(pa.array(at)), int(dim)), axes)
                for k, row in zip(at, np.floor(p / eps).astype(np.int32)):
                    cells[k] = row
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cells, pa.list_(pa.int32()))], [*batch.schema.names, "cells"]
            )

    def emit(rows, dim, label, index):
        x = np.frombuffer(b"".join(r[2] for r in rows)).reshape(-1, dim)
        p = _project(x, axes)
        lo, hi = p.min(axis=0), p.max(axis=0)
        cells = np.floor(p[:, :GRID] / eps).astype(np.int32)
        return (
            index, label, dim, len(rows), lo, hi, cells.min(axis=0), cells.max(axis=0),
            np.array([r[0] for r in rows], dtype=np.int64).tobytes(),
            np.array([r[1] for r in rows], dtype=np.int64).tobytes(), x.tobytes(),
        )

    def cut(batches):
        from pyspark import TaskContext

        index = TaskContext.get().partitionId() << 32
        held, key = [], None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("node", "copies", "label", "dim")]
            vectors = batch.column("vector")
            offsets = vectors.offsets.to_numpy()
            raw = vectors.values.to_numpy(zero_copy_only=False)
            out = []
            for k, (node, copies, label, dim) in enumerate(zip(*columns)):
                if held and (key != (label, dim) or len(held) == BLOCK):
                    out.append(emit(held, key[1], key[0], index))
                    index, held = index + 1, []
                key = (label, dim)
                held.append((node, copies, raw[offsets[k] : offsets[k + 1]].tobytes()))
            if out:
                yield _block_batch(out)
        if held:
            yield _block_batch([emit(held, key[1], key[0], index)])

    schema = "node bigint, copies bigint, label string, dim int, vector array<double>"
    placed = nodes.select("node", "copies", "label", "dim", "vector").mapInArrow(place, schema + ", cells array<int>")
    # The node ends the key, so equal cells can be split, and a label is as many ranges as it needs.
    ordered = placed.repartitionByRange("label", "dim", "cells", "node").sortWithinPartitions("label", "dim", "cells", "node")
    return ordered.mapInArrow(cut, BLOCKS)


def _block_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), *[pa.list_(pa.float64())] * 2, *[pa.list_(pa.int32())] * 2,
             *[pa.binary()] * 3]
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def _block_pairs(blocks: DataFrame, cosine: float) -> DataFrame:
    """Return (one, two) of all pairs of blocks, one <= two, whose bounds come as near as linked vectors do.

    Only bounds are joined: on the grid cells that one block touches and the other's neighbours touch. A pair meets in
    many cells and is kept in the first.
    """
    bounds = blocks.select("block", "label", "dim", "lo", "hi", "cells_lo", "cells_hi")

    def spread(df, wider, name):
        for k in range(GRID):
            ends = [F.coalesce(F.get(c, k), F.lit(0)) for c in ("cells_lo", "cells_hi")]
            df = df.withColumn(f"c{k}", F.explode(F.sequence(ends[0] - wider, ends[1] + wider)))
        return df.select("label", "dim", *[f"c{k}" for k in range(GRID)], F.struct("block", "lo", "hi", "cells_lo").alias(name))

    joined = spread(bounds, 0, "x").join(spread(bounds, 1, "y"), ["label", "dim", *[f"c{k}" for k in range(GRID)]])
    first = F.lit(True)
    for k in range(GRID):
        x, y = (F.coalesce(F.get(F.col(f"{s}.cells_lo"), k), F.lit(0)) for s in "xy")
        first = first & (F.col(f"c{k}") == F.greatest(x, y - 1))
    gaps = F.zip_with(
        F.arrays_zip("x.lo", "x.hi"), F.arrays_zip("y.lo", "y.hi"),
        lambda a, b: F.greatest(F.lit(0.0), a["lo"] - b["hi"], b["lo"] - a["hi"]),
    )
    near = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g) <= _reach(cosine) ** 2
    return joined.where((F.col("x.block") <= F.col("y.block")) & first & near).select(
        F.col("x.block").alias("one"), F.col("y.block").alias("two")
    )


def _near_leaves(p, q, eps, same):
    """Join two sequence intervals recursively; yield (a, b, c, d) of leaf intervals that may hold links."""
    stack = [(0, len(p), 0, len(q))]
    while stack:
        a, b, c, d = stack.pop()
        if same and c < a and (c, d) != (a, b):
            continue
        lo = np.maximum(p[a:b].min(axis=0), q[c:d].min(axis=0))
        hi = np.minimum(p[a:b].max(axis=0), q[c:d].max(axis=0))
        if (np.maximum(lo - hi, 0.0) ** 2).sum() > eps * eps:
            continue
        if b - a <= LEAF and d - c <= LEAF:
            yield a, b, c, d
            continue
        halves = [(a, b)] if b - a <= LEAF else [(a, (a + b) // 2), ((a + b) // 2, b)]
        others = [(c, d)] if d - c <= LEAF else [(c, (c + d) // 2), ((c + d) // 2, d)]
        stack += [(*h, *o) for h in halves for o in others]


LINKS = "node bigint, links bigint, least bigint"


def _compare(pairs: DataFrame, axes: tuple[int, np.ndarray], cosine: float) -> DataFrame:
    """Return per block pair and linked node: the links it adds and the smallest node it reaches within the pair."""
    eps = _reach(cosine)

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                same = r["one"] == r["two"]
                x = np.frombuffer(r["x_vectors"]).reshape(-1, r["dim"])
                y = x if same else np.frombuffer(r["y_vectors"]).reshape(-1, r["dim"])
                p, q = _project(x, axes), _project(y, axes)
                nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
                mx, my = (np.frombuffer(r[c], dtype=np.int64) for c in ("x_copies", "y_copies"))
                nodes = np.frombuffer(r["x_nodes"], dtype=np.int64)
                nodes = nodes if same else np.concatenate((nodes, np.frombuffer(r["y_nodes"], dtype=np.int64)))
                shift = 0 if same else len(x)
                links = np.zeros(len(nodes), dtype=np.int64)
                ends = [np.zeros((2, 0), dtype=np.int64)]
                for a, b, c, d in _near_leaves(p, q, eps, same):
                    hit = (x[a:b] @ y[c:d].T) / (nx[a:b, None] * ny[None, c:d]) >= cosine
                    if same and (a, b) == (c, d):
                        hit = np.triu(hit, 1)
                    i, j = np.nonzero(hit)
                    if len(i) == 0:
                        continue
                    links[a:b] += hit @ my[c:d]
                    links[c + shift : d + shift] += hit.T @ mx[a:b]
                    part = least_reachable(b - a + d - c, i, j + (b - a))
                    back = np.concatenate((np.arange(a, b), np.arange(c, d) + shift))
                    moved = np.flatnonzero(part != np.arange(len(part)))
                    ends.append(np.stack((back[moved], back[part[moved]])))
                ends = np.concatenate(ends, axis=1)
                if ends.shape[1] == 0:
                    continue
                order = np.argsort(nodes)
                rank = np.empty_like(order)
                rank[order] = np.arange(len(order))
                least = nodes[order][least_reachable(len(nodes), rank[ends[0]], rank[ends[1]])[rank]]
                at = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes[at]), pa.array(links[at]), pa.array(least[at])], ["node", "links", "least"]
                )

    return pairs.mapInArrow(run, LINKS)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Link vectors (vec_id BIGINT, embedding ARRAY, label) of equal labels and lengths with a cosine >= ``cosine``.

    Returns per row ``vec_id``, ``n_links`` (rows linked directly), ``component_id`` (smallest vec_id reachable) and
    ``kept``. Vectors that cannot link (see ``cleaned``) have no links and their own component; rows that repeat a
    vec_id share its component, and each counts as a link of the other; a NULL vec_id has a NULL component.

    Equal vectors are one node. Nodes are sorted in epsilon grid order over leading principal dimensions and cut into
    blocks; pairs of blocks with near bounds are joined recursively, skipping intervals that are provably distant. A
    pair of blocks gives at most one row per vector (its links there, the smallest node it reaches there), so dense
    groups do not become pairs, and every pair of blocks is a task's row of its own, so no label is a task.
    """
    scratch = Scratch(vectors.sparkSession)
    clean = cleaned(vectors)
    grouped = clean.groupBy("label", "dim", "vector").agg(
        F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")
    )
    nodes = scratch.put(grouped)
    axes = principal_axes(nodes)
    blocks = scratch.put(_in_blocks(nodes, axes, cosine))
    left = blocks.select(
        F.col("block").alias("one"), "dim", *[F.col(c).alias(f"x_{c}") for c in ("nodes", "copies", "vectors")]
    )
    right = blocks.select(F.col("block").alias("two"), *[F.col(c).alias(f"y_{c}") for c in ("nodes", "copies", "vectors")])
    pairs = _block_pairs(blocks, cosine).join(left, "one").join(right, "two")
    found = scratch.put(_compare(pairs, axes, cosine))
    groups = connected_components(found.select(F.col("node").alias("a"), F.col("least").alias("b")), scratch)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    settled = (
        nodes.join(links, "node", "left").join(groups, "node", "left")
        .select(
            "label", "dim", "vector", F.coalesce("component", "node").alias("component_id"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    # Each row finds its node by the vector itself, hashed to keep the shuffled key short.
    key = F.sha2(F.concat_ws("|", "label", F.to_json("vector")), 256)
    mine = clean.select("vec_id", key.alias("_key"))
    placed = mine.join(settled.select(key.alias("_key"), "component_id", "n_links"), "_key").drop("_key")
    linked = placed.groupBy("vec_id").agg(F.min("component_id").alias("component_id"), F.max("n_links").alias("n_links"))
    out = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id")).join(linked, "vec_id", "left")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all embeddings."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP1_SQL = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
    AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (SELECT vec_id AS d, vec_id AS r FROM embeddings UNION SELECT d, b FROM reach JOIN links ON a = r)
SELECT d AS vec_id, (SELECT count(*) FROM links WHERE a = d)::BIGINT AS n_links, min(r) AS component_id,
  d = min(r) AS kept
FROM reach GROUP BY d
"""
