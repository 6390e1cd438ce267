"""Hard-negative mining: slots between the upper limits of an anchor's positives, and their best negatives."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskaudit.llm.scratch import Scratch

POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90  # percent of the positive's score that a negative's score lies between
ANCHORS = 1024  # anchors of one block
ROWS = 2048  # rows of one block
GROUP = 4  # 2**GROUP blocks of a task number go to a group of anchors or a cell of rows
SALTS = 32  # copies of the anchors, which pairs of groups and cells are dealt to
NOTHING = np.int64(-(2**63))  # below every score


def usable(vectors: DataFrame, label: Column, component) -> DataFrame:
    """Return (id, label, vector: BIGINT array) of rows that take part.

    Left out: a NULL id, label or vector, and vectors with a NULL, NaN or infinite component. ``component`` makes an
    integer of each DOUBLE component.
    """
    values = F.transform("embedding", lambda x: x.cast("double"))
    sane = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        vectors.select(F.col("vec_id").cast("bigint").alias("id"), label.cast("bigint").alias("label"), values.alias("_v"))
        .where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("_v").isNotNull() & sane)
        .select("id", "label", F.transform("_v", lambda x: component(x).cast("bigint")).alias("vector"))
    )


BLOCKS = "block bigint, dim int, labels_in array<bigint>, ids binary, labels binary, kind string, vectors binary, limits binary"


def _in_blocks(rows: DataFrame, size: int) -> DataFrame:
    """Sort rows by label and cut the sequence into blocks of at most ``size`` vectors of one length.

    Label, id, the vector's hash and the task it came from make the key, so a label is as many ranges as it needs.
    """

    def emit(block, dim, parts):
        ids, labels, vectors, limits = (np.concatenate([p[k] for p in parts]) for k in range(4))
        top = np.abs(vectors.astype(np.float64)).max(initial=0.0)
        kind = "<i2" if top < 2**15 else "<i4" if top < 2**31 else "<i8"
        return pa.RecordBatch.from_arrays(
            [pa.array([block]), pa.array([dim], pa.int32()), pa.array([np.unique(labels)], pa.list_(pa.int64())),
             pa.array([ids.tobytes()]), pa.array([labels.tobytes()]), pa.array([kind]), pa.array([vectors.astype(kind).tobytes()]),
             pa.array([limits.tobytes()])],
            [c.split()[0] for c in BLOCKS.split(", ")],
        )

    def matrix(column, a, b, width):
        part = column.slice(a, b - a)
        return part.flatten().to_numpy(zero_copy_only=False).astype("<i8").reshape(b - a, width)

    def cut(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        held, dim, n = [], None, 0
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            ids, labels = (batch.column(c).to_numpy().astype("<i8") for c in ("id", "label"))
            edges = np.concatenate(([0], np.flatnonzero(dims[1:] != dims[:-1]) + 1, [len(dims)]))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                while a < b:
                    if held and (dim != dims[a] or n == size):
                        yield emit(block, dim, held)
                        block, held, n = block + 1, [], 0
                    dim, to = int(dims[a]), min(b, a + size - n)
                    width = len(batch.column("limits")[a])
                    held.append((ids[a:to], labels[a:to], matrix(batch.column("vector"), a, to, dim), matrix(batch.column("limits"), a, to, width)))
                    n, a = n + to - a, to
        if held:
            yield emit(block, dim, held)

    keyed = rows.select(
        "id", "label", "vector", "limits", F.size("vector").alias("dim"), F.xxhash64("vector").alias("_h"),
        F.spark_partition_id().alias("_p"),
    )
    order = ["dim", "label", "id", "_h", "_p"]
    sequence = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    return sequence.select("id", "label", "dim", "vector", "limits").mapInArrow(cut, BLOCKS)


def _meetings(anchors: DataFrame, rows: DataFrame, by_label: bool) -> DataFrame:
    """Return every pair of a block of anchors and a block of rows, of one vector length and, ``by_label``, a common label.

    Blocks go to groups of anchors and cells of rows of bounded size. Only the numbers of groups and cells are
    paired; anchors then go once to each cell's task and rows once to each group's.
    """
    anchors = anchors.withColumn("group", F.shiftright("block", GROUP))
    rows = rows.withColumn("cell", F.shiftright("block", GROUP))
    salt = F.pmod(F.xxhash64("cell"), F.lit(SALTS)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    label = [F.explode("labels_in").alias("label")] if by_label else []
    on = ["dim", "salt", *(["label"] if by_label else [])]
    groups = anchors.select("group", "dim", *label).distinct().withColumn("salt", every)
    cells = rows.select("cell", "dim", *label).distinct().withColumn("salt", salt)
    pairs = groups.join(cells, on).select("group", "cell", "dim", "salt").distinct()
    left = pairs.join(anchors.withColumn("salt", every).drop("labels_in", "block"), ["group", "dim", "salt"])
    right = pairs.select("group", "cell", "dim").join(rows.drop("labels_in", "block", "limits"), ["cell", "dim"])
    names = ("ids", "labels", "kind", "vectors", "limits")
    return left.select("group", "cell", "dim", *[F.col(c).alias(f"x_{c}") for c in names]).join(
        right.select("group", "cell", "dim", *[F.col(c).alias(f"y_{c}") for c in names[:-1]]), ["group", "cell", "dim"]
    ).drop("group", "cell")


def inner_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Return the exact BIGINT inner products of integer rows; results outside BIGINT become its ends."""
    bound = float(np.abs(x.astype(np.float64)).max(initial=0)) * float(np.abs(y.astype(np.float64)).max(initial=0)) * x.shape[1]
    if bound < 2**53:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    if bound < 2**62:
        return x.astype(np.int64) @ y.astype(np.int64).T
    exact = x.astype(object) @ y.astype(object).T if x.shape[1] else np.zeros((len(x), len(y)))
    return np.clip(exact, -(2**63) + 1, 2**63 - 1).astype(np.int64)


def best_of(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Return (row, column) of the ``k`` highest scores of each row, above NOTHING; of equal ones the first columns."""
    if scores.shape[1] > k:
        cut = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        hits = (scores >= cut[:, None]) & (scores > NOTHING)
    else:
        hits = scores > NOTHING
    row, column = np.nonzero(hits)
    order = np.lexsort((column, ~scores[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def _scored(r: dict):
    """Return anchors' ids, labels and limits, and rows' ids, labels and scores, rows ordered by id."""
    dim = r["dim"]
    x_ids, y_ids, x_labels, y_labels = (np.frombuffer(r[c], dtype="<i8") for c in ("x_ids", "y_ids", "x_labels", "y_labels"))
    x = np.frombuffer(r["x_vectors"], dtype=r["x_kind"]).reshape(len(x_ids), dim)
    y = np.frombuffer(r["y_vectors"], dtype=r["y_kind"]).reshape(len(y_ids), dim)
    order = np.argsort(y_ids, kind="stable")
    limits = np.frombuffer(r["x_limits"], dtype="<i8").reshape(len(x_ids), -1)
    return x_ids, x_labels, limits, y_ids[order], y_labels[order], inner_products(x, y[order])


FOUND = "anchor bigint, slot int, score bigint, id bigint"


def _positives(meetings: DataFrame, k: int) -> DataFrame:
    """Return per pair of blocks and anchor the ``k`` best other rows of its label."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                x_ids, x_labels, _, y_ids, y_labels, scores = _scored(r)
                fit = (x_labels[:, None] == y_labels[None, :]) & (x_ids[:, None] != y_ids[None, :])
                i, j = best_of(np.where(fit, scores, NOTHING), k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x_ids[i]), pa.array(np.zeros(len(i), dtype=np.int32)), pa.array(scores[i, j]), pa.array(y_ids[j])],
                    ["anchor", "slot", "score", "id"],
                )

    return meetings.mapInArrow(run, FOUND)


def _negatives(meetings: DataFrame, k: int) -> DataFrame:
    """Return per pair of blocks, anchor and slot the ``k`` best rows of other labels.

    An anchor's limits are its positives' different upper limits in descending order (slot s lies above limit s + 1 and
    reaches up to limit s; missing ones repeat the last and leave their slot empty), and last the least lower limit.
    """

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                x_ids, x_labels, limits, y_ids, y_labels, scores = _scored(r)
                fit = (x_labels[:, None] != y_labels[None, :]) & (x_ids[:, None] != y_ids[None, :])
                fit &= (scores >= limits[:, -1:]) & (scores <= limits[:, :1])
                scores = np.where(fit, scores, NOTHING)
                for slot in range(limits.shape[1] - 1):
                    inside = scores <= limits[:, slot, None]
                    if slot + 2 < limits.shape[1]:
                        inside &= scores > limits[:, slot + 1, None]
                    i, j = best_of(np.where(inside, scores, NOTHING), k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x_ids[i]), pa.array(np.full(len(i), slot, dtype=np.int32)), pa.array(scores[i, j]), pa.array(y_ids[j])],
                        ["anchor", "slot", "score", "id"],
                    )

    return meetings.mapInArrow(run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    """Keep the ``k`` best rows per anchor and slot; Spark limits them before and after its shuffle."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= k).drop("_place")


def _percent(share: int, up: bool) -> Column:
    """Return ``share`` percent of the BIGINT ``score`` as the next integer, without leaving BIGINT on the way."""
    whole = "(score div 100 - int(score % 100 < 0))"
    return F.expr(f"{whole} * {share} + (pmod(score, 100) * {share} + {99 if up else 0}) div 100")


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH
) -> DataFrame:
    """Mine hard negatives from ``rows`` (id, label, vector: BIGINT array; no NULLs, see ``usable``).

    A row's score is its inner product with the anchor; higher scores come first, ties by smaller id. Anchors are the
    rows that satisfy ``is_anchor``; all other rows of the anchor's label are ranked, and the first ``positives`` are its
    positives. Returns, for each anchor and positive, the first ``negatives`` rows of another label whose score lies
    between ``low`` and ``high`` percent of the positive's: anchor_id, positive_id, rank (INT, from 1), negative_id,
    positive_score, negative_score.

    The positives' upper limits split scores into disjoint slots. Blocks of anchors are held against blocks of all
    rows; each pair of blocks and then each task keeps the best of every slot, and a window's answer is the beginning of
    its slot followed by all lower ones, down to its lower limit. Nothing but these best rows is shuffled by anchor.

    Vectors of different lengths have no score. Rows with an anchor's id are the anchor itself: neither its positives nor
    its negatives. Of several rows with one anchor id the one with the smallest label, then vector, is the anchor;
    repeated rows otherwise count as rows of their own. A label with one row has no positives and gives no rows, nor does
    an empty table. Scores outside BIGINT become its ends.
    """
    scratch = Scratch(rows.sparkSession)
    plain = rows.select("id", "label", "vector", F.array().cast("array<bigint>").alias("limits"))
    anchors = (
        plain.where(is_anchor).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("_r"))
        .select("id", "_r.label", "_r.vector", F.array().cast("array<bigint>").alias("limits"))
    )
    blocks = scratch.put(_in_blocks(plain, ROWS))
    anchors = scratch.put(anchors)
    near = _best(_positives(_meetings(_in_blocks(anchors, ANCHORS), blocks, True), positives), positives)
    one = F.struct(
        "score", "id", _percent(high, False).alias("top"), _percent(low, True).alias("bottom")
    )
    windows = scratch.put(near.groupBy("anchor").agg(F.collect_list(one).alias("windows")).select(
        "anchor", "windows", F.sort_array(F.array_distinct("windows.top"), asc=False).alias("tops")
    ))
    missing = F.array_repeat(F.element_at("tops", -1), F.lit(positives) - F.size("tops"))
    limits = F.concat("tops", missing, F.array(F.array_min("windows.bottom")))
    bounded = anchors.drop("limits").join(windows.select(F.col("anchor").alias("id"), limits.alias("limits")), "id")
    found = _best(_negatives(_meetings(_in_blocks(bounded, ANCHORS), blocks, False), negatives), negatives)
    slots = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("slot", (-F.col("score")).alias("minus"), "id"))).alias("best"))
    asked = windows.join(slots, "anchor").select("anchor", "tops", "best", F.explode("windows").alias("w"))
    answer = F.slice(
        F.filter("best", lambda b: (b["slot"] >= F.array_position("tops", F.col("w.top")) - 1) & (-b["minus"] >= F.col("w.bottom"))),
        1, negatives,
    )
    return asked.select("anchor", "w", F.posexplode(answer).alias("place", "b")).select(
        F.col("anchor").alias("anchor_id"), F.col("w.id").alias("positive_id"), (F.col("place") + 1).cast("int").alias("rank"),
        F.col("b.id").alias("negative_id"), F.col("w.score").alias("positive_score"), (-F.col("b.minus")).alias("negative_score"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of all embeddings, components in steps of 1/256 and a seventh of the rows in the next label."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(usable(vectors, label, lambda x: F.floor(256 * x)), F.col("id") % 100 == 0)


OP11_SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), ranked AS (
  SELECT p.anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank
  FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT same
    AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT * FROM ranked WHERE rank <= 10
"""
