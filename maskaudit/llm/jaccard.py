"""N-gram Jaccard join: the n-gram order is cut into fragments and partial overlaps are summed per pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskaudit.llm import hashing as H
from maskaudit.llm.components import connected_components, least_reachable
from maskaudit.llm.scratch import Scratch

NGRAM = 4
THRESHOLD = (85, 100)  # links have THRESHOLD[1] * intersection >= THRESHOLD[0] * union
CUT = 4096  # n-grams of one fragment of the order in which overlaps are counted
BLOCK_SETS, BLOCK_GRAMS = 256, 1 << 18  # sets and n-grams of a block, about
BLOCK_ROWS = 8  # pairs of blocks that go to Python together
TOGETHER = 1 << 18  # keys that a task sends at once
BUCKET = 1 << 18  # keys of equal fragments that one task looks at
STEP = 1.5  # ratio of neighbouring fragment numbers
MEMBER = "doc_id bigint, n bigint, owner bigint, level int, needs array<int>"
PREFIX = 63  # the level that stands for keys of the prefix filter


def most_differences(size: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """Return how many n-grams two linked sets can differ by at most, the larger having ``size``."""
    part, whole = threshold
    return (2 * size * (whole - part)) // (whole + part)


def fragment_level(size: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """Return the level of sets of ``size``: at level k there are STEP**k fragments, rounded up, which has to be a
    quarter more than the differences of linked sets + 1."""
    need = 1.25 * (most_differences(size, threshold) + 1)
    return np.ceil(np.log(need) / np.log(STEP) - 1e-9).astype(np.int64)


def level_differences(level: np.ndarray) -> np.ndarray:
    """Return how many n-grams linked sets can differ by at most, the larger being of ``level``."""
    return np.floor(STEP**level / 1.25 + 1e-9).astype(np.int64) - 1


def _sets(texts: list[str | None], n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for i, j in H.batches(texts):
        yield i, j, *H.distinct(*H.shingles(*H.word_hashes(texts[i:j]), n))


def _owners(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Return one BIGINT per set that equal sets share."""
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(H.mix(values ^ H.ODD), dtype=np.uint64)))
    size = np.diff(offsets).astype(np.uint64)
    return (H.mix((sums[offsets[1:]] - sums[offsets[:-1]]) * H.BASE + size) >> np.uint64(1)).astype(np.int64)


def members(docs: DataFrame, n: int = NGRAM, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Return (doc_id, n: distinct n-grams, owner: what equal sets share; NULL without words, level: of its size,
    needs: how many keys of that level, and of each one above, it shares with a linked set that meets it there)."""

    def run(batches):
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id")
            for i, j, values, offsets in _sets(texts, n):
                size = np.diff(offsets)
                owner = pa.array(_owners(values, offsets), mask=size == 0)
                level = fragment_level(size, threshold)
                most = most_differences(size * threshold[1] // threshold[0], threshold)
                needs = [
                    np.maximum(filled - np.minimum(most, level_differences(level + up)), 1)
                    for up, (_, filled, _) in enumerate(_by_level(values, offsets, threshold))
                ]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(size), owner, pa.array(level.astype(np.int32)),
                     pa.array(list(np.array(needs, dtype=np.int32).T), pa.list_(pa.int32()))],
                    ["doc_id", "n", "owner", "level", "needs"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, MEMBER)


def _by_level(values, offsets, threshold):
    """Cut sets at their own level and at each one above that a linked larger set can have.

    Yields (which sets have the level, filled fragments per set, (set, fragment, number of fragments, begin) of those).
    """
    size = np.diff(offsets)
    part, whole = threshold
    own, above = fragment_level(size, threshold), fragment_level(size * whole // part, threshold)
    for up in range(int((above - own).max(initial=0)) + 1):
        which = (size > 0) & (own + up <= above)
        numbers = np.ceil(STEP ** (own + up)).astype(np.int64)
        owner = np.repeat(np.arange(len(size)), size)
        at = ((values >> np.uint64(32)) * numbers[owner].astype(np.uint64)) >> np.uint64(32)
        first = np.ones(len(values), dtype=bool)
        first[1:] = (owner[1:] != owner[:-1]) | (at[1:] != at[:-1])
        begin = np.flatnonzero(first)
        held = owner[begin]
        filled = np.where(which, np.bincount(held, minlength=len(size)), 0)
        yield which, filled, (held, at[begin], numbers[held], begin)


LEVEL_BITS = np.uint64(PREFIX << 32)


def _fragment_keys(values, offsets, threshold) -> tuple[np.ndarray, np.ndarray]:
    """Return (key, set index): keys of which two linked sets share at least one. Bits 32 to 37 hold the level.

    Two linked sets differ by at most d n-grams, and each spoils one fragment only. So if either set fills more than
    d fragments, one of its fragments is whole in both. Where they meet, d is bounded by the level, which is that of the larger
    one, and by the largest set that can be linked. Sets that fill too few also put out the first n-grams of their sets
    (prefix filter), so two such sets meet there.
    """
    size = np.diff(offsets)
    part, whole = threshold
    limit = most_differences(size * whole // part, threshold)
    mixed = H.mix(values + H.ODD)
    keys, owners = [], []
    few = np.zeros(len(size), dtype=bool)
    level = fragment_level(size, threshold)
    for up, (which, filled, (held, fragment, numbers, begin)) in enumerate(_by_level(values, offsets, threshold)):
        if len(begin):
            total = np.add.reduceat(mixed, begin)
            key = H.mix(total + H.mix(fragment * H.ODD + numbers.astype(np.uint64) * H.BASE))
            key = (key & ~LEVEL_BITS) | ((level[held] + up).astype(np.uint64) << np.uint64(32))
            keys.append(key[which[held]])
            owners.append(held[which[held]])
        few |= which & (filled <= np.minimum(limit, level_differences(level + up)))
    if few.any():
        rank = np.arange(len(values)) - np.repeat(offsets[:-1], size)
        prefix = size - (part * size + whole - 1) // whole + 1
        here = np.repeat(few, size) & (rank < np.repeat(prefix, size))
        keys.append(H.mix(values[here] ^ H.BASE) | LEVEL_BITS)
        owners.append(np.repeat(np.arange(len(size)), size)[here])
    if not keys:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.concatenate(keys), np.concatenate(owners)


GROUPED = "bucket int, local boolean, keys binary, owners binary"


def shared_keys(docs: DataFrame, buckets: int, n: int = NGRAM, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Return (key, owner) of all fragment keys that at least two different sets have; its lowest 6 bits: the level.

    A run of about TOGETHER keys sends each of its keys to the key's bucket once, with the smallest owner that has it;
    what a run finds to be shared within itself goes to a bucket of its own choice. So a key that very many sets have
    reaches its bucket once per run, a bucket holds about BUCKET keys, whatever the size of the table, and a task
    holds one run. A key is its bucket and 40 bits, so that few keys are shared by chance.
    """

    def spread(batches):
        keys, owners = [], []
        for batch in batches:
            for _, _, values, offsets in _sets(batch.column("text").to_pylist(), n):
                key, owner = _fragment_keys(values, offsets, threshold)
                keys.append(key)
                owners.append(_owners(values, offsets)[owner])
                if sum(map(len, keys)) >= TOGETHER:
                    yield from sent(np.concatenate(keys), np.concatenate(owners))
                    keys, owners = [], []
        if keys:
            yield from sent(np.concatenate(keys), np.concatenate(owners))

    def sent(key, owner):
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        fresh = np.ones(len(key), dtype=bool)
        fresh[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
        key, owner = key[fresh], owner[fresh]
        first = np.ones(len(key), dtype=bool)
        first[1:] = key[1:] != key[:-1]
        again = ~first
        many = again | np.concatenate((again[1:], [False])) if len(key) else again
        out = []
        if many.any():
            out.append((int(key[0] % np.uint64(buckets)), True, key[many].tobytes(), owner[many].tobytes()))
        key, owner = key[first], owner[first]
        bucket = (key % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        key, owner, bucket = key[order], owner[order], bucket[order]
        high, low = (key >> np.uint64(32)).astype(np.uint32), (key >> np.uint64(24)).astype(np.uint8)
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(bucket)]):
            out.append((int(bucket[a]), False, high[a:b].tobytes() + low[a:b].tobytes(), owner[a:b].tobytes()))
        if out:
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.bool_()),
                 pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())],
                ["bucket", "local", "keys", "owners"],
            )

    def gather(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        keys, owners, once, holder = [], [], [], []
        for local, key, owner in zip(*(table.column(c).to_pylist() for c in ("local", "keys", "owners"))):
            owner = np.frombuffer(owner, dtype=np.int64)
            if local:
                full = np.frombuffer(key, dtype=np.uint64)
                low = (full >> np.uint64(24)) & np.uint64(255)
                keys.append(((full % np.uint64(buckets)) << np.uint64(40)) | (low << np.uint64(32)) | (full >> np.uint64(32)))
                owners.append(owner)
            else:
                high, low = np.frombuffer(key, np.uint32, len(owner)), np.frombuffer(key, np.uint8, offset=4 * len(owner))
                once.append((low.astype(np.uint64) << np.uint64(32)) | high)
                holder.append(owner)
        if once:
            key, owner = np.concatenate(once), np.concatenate(holder)
            order = np.lexsort((owner, key))
            key, owner = key[order], owner[order]
            fresh = np.ones(len(key), dtype=bool)
            fresh[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
            key, owner = key[fresh], owner[fresh]
            same = key[1:] == key[:-1]
            many = np.concatenate((same, [False])) | np.concatenate(([False], same))
            keys.append((np.uint64(bucket) << np.uint64(40)) | key[many])
            owners.append(owner[many])
        return pa.table({
            "key": np.concatenate(keys).astype(np.int64), "owner": np.concatenate(owners),
        })

    spreaded = docs.select("text").mapInArrow(spread, GROUPED)
    return spreaded.groupBy("bucket").applyInArrow(gather, "key bigint, owner bigint")


def _sets_of(docs: DataFrame, n: int) -> DataFrame:
    """Return (cluster, level, block, owner, grams: its n-grams in order) of ``docs`` (text and all but the last)."""

    def run(batches):
        for batch in batches:
            for i, j, values, offsets in _sets(batch.column("text").to_pylist(), n):
                # An id can stand for several texts; only the one that the owner was made of is meant.
                meant = np.flatnonzero(_owners(values, offsets) == batch.column("owner").slice(i, j - i).to_numpy())
                raw = [values[offsets[k] : offsets[k + 1]].tobytes() for k in meant]
                rows = pa.array(meant + i)
                names = ["cluster", "level", "block", "owner"]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(rows) for c in names), pa.array(raw, pa.binary())], [*names, "grams"]
                )

    return docs.select("text", "cluster", "level", "block", "owner").mapInArrow(
        run, "cluster bigint, level int, block int, owner bigint, grams binary"
    )


def overlaps(one: list[np.ndarray], two: list[np.ndarray], cut: int = CUT) -> np.ndarray:
    """Return the overlap of each set of ``one`` with each of ``two`` (distinct values in order).

    The order of all values is cut into fragments of ``cut`` values. In each fragment the sets are rows of zeros and
    ones, whose products are the partial overlaps; these are summed per pair.
    """
    values, place = np.unique(np.concatenate([*one, *two]), return_inverse=True)
    row = np.repeat(np.arange(len(one) + len(two)), [len(x) for x in (*one, *two)])
    total = np.zeros((len(one), len(two)), dtype=np.float32)
    order = np.argsort(place, kind="stable")
    place, row = place[order], row[order]
    for low in range(0, len(values), cut):
        a, b = np.searchsorted(place, (low, low + cut))
        held = np.zeros((len(one) + len(two), cut), dtype=np.float32)
        held[row[a:b], place[a:b] - low] = 1.0
        total += held[: len(one)] @ held[len(one) :].T
    return total.astype(np.int64)


def _links(rows: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Compare the sets of ``one`` with those of ``two`` (NULL: with each other) in each row.

    Returns (a, b): per row, each set that is linked, and the smallest owner it reaches by links within the row.
    """
    part, whole = threshold

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):  # one at a time: a batch of rows may be large
                r = batch.slice(k, 1).to_pylist()[0]
                one, two = r["one"], r["two"] or []
                sets = [np.frombuffer(x["grams"], dtype=np.uint64) for x in (*one, *two)]
                owners = np.array([x["owner"] for x in (*one, *two)], dtype=np.int64)
                size = np.array([len(x) for x in sets])
                shift = len(one) if two else 0
                common = overlaps(sets[: len(one)], sets[shift:])
                union = size[: len(one), None] + size[None, shift:] - common
                hit = whole * common >= part * union
                i, j = np.nonzero(hit if two else np.triu(hit, 1))
                if len(i) == 0:
                    continue
                order = np.argsort(owners)
                rank = np.empty_like(order)
                rank[order] = np.arange(len(order))
                least = owners[order][least_reachable(len(owners), rank[i], rank[j + shift])[rank]]
                at = np.flatnonzero(least != owners)
                yield pa.RecordBatch.from_arrays([pa.array(owners[at]), pa.array(least[at])], ["a", "b"])

    return rows.select("one", "two").mapInArrow(run, "a bigint, b bigint")


def jaccard_components(
    docs: DataFrame, n: int = NGRAM, threshold: tuple[int, int] = THRESHOLD
) -> DataFrame:
    """Group documents whose n-gram sets have a Jaccard similarity of at least ``threshold``, exactly.

    Returns per row of ``docs`` (doc_id BIGINT, text): ``doc_id``, ``n_shingles`` and ``component_id``, the smallest
    doc_id reachable by links. 64-bit hashes stand for n-grams and for whole sets.

    1. Equal sets are one node. The n-gram order (by hash) is cut into fragments, more of them than linked sets can
       differ in; nodes that share a whole fragment are candidates. Passages that many texts share fill no fragment.
    2. Of its keys a set keeps the rarest, so many that linked sets still share one of those. What hangs together by these is a
       cluster, cut into blocks by size and hash. Blocks of a cluster whose sizes allow links are compared, each pair of blocks in a row of its own: overlaps are counted in each fragment of the
       order separately and summed per pair of sets. A row gives at most one link per set, so a dense group of near
       copies does not become pairs.
    3. Links are joined up.

    Texts without words are linked with nothing, whatever their number. Rows that repeat are kept; a NULL doc_id has a
    NULL component; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    own = scratch.put(members(docs, n, threshold))
    nodes = own.where(F.col("owner").isNotNull() & F.col("doc_id").isNotNull()).groupBy("owner").agg(
        F.min("doc_id").alias("first_id"), *[F.first(c).alias(c) for c in ("n", "level", "needs")]
    )
    total = own.agg(F.sum("n")).collect()[0][0] or 0
    shared = scratch.put(shared_keys(docs.where(F.col("doc_id").isNotNull()), int(0.4 * total) // BUCKET + 1, n, threshold))
    rarest = scratch.put(_rarest(shared, nodes))
    scratch.drop(shared)
    clusters = connected_components(_candidate_links(rarest), scratch)
    scratch.drop(rarest)
    placed = clusters.select(F.col("node").alias("owner"), F.col("component").alias("cluster")).join(nodes, "owner")
    sizes = placed.groupBy("cluster", "level").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("grams"))
    number = F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("grams") / BLOCK_GRAMS))
    placed = placed.join(sizes.select("cluster", "level", number.alias("blocks")), ["cluster", "level"]).select(
        "cluster", "level", F.pmod(F.xxhash64("owner"), "blocks").cast("int").alias("block"), "owner",
        F.col("first_id").alias("doc_id"),
    )
    # Rows of one doc_id are together after the join, so repeated ones go without another shuffle.
    found = docs.join(placed, "doc_id").withColumn("_text", F.xxhash64("text")).dropDuplicates(["doc_id", "owner", "_text"])
    key = ["cluster", "level", "block"]
    blocks = scratch.put(
        _sets_of(found, n).groupBy(*key).agg(F.collect_list(F.struct("owner", "grams")).alias("sets"))
    )
    alone = blocks.where(F.size("sets") > 1).select(F.col("sets").alias("one"), F.lit(None).cast(SETS).alias("two"))
    # A row holds two blocks, some megabytes: few go to Python together.
    links = scratch.put(_links(alone, threshold).unionByName(_links(_block_pairs(blocks, threshold), threshold)), BLOCK_ROWS)
    scratch.drop(blocks)
    joined = connected_components(links, scratch)
    smallest = (
        nodes.join(joined.withColumnRenamed("node", "owner"), "owner", "left")
        .withColumn("component", F.coalesce("component", "owner"))
    )
    ids = smallest.groupBy("component").agg(F.min("first_id").alias("component_id"))
    labels = smallest.join(ids, "component").select("owner", "component_id")
    out = own.join(labels, "owner", "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )


def _rarest(shared: DataFrame, nodes: DataFrame) -> DataFrame:
    """Keep of the keys of an owner and level the rarest ones, so many that any two linked sets still share one of those.

    Put the keys in one order, those that fewer owners have first. The first one of the at least ``need`` keys that two linked
    sets share has ``need`` - 1 of them after it in either set, so it is not among the last ``need`` - 1 keys of a set. Those are
    passages that many texts share, for most sets; a set that shares fewer than ``need`` keys keeps none.
    """
    level = F.col("key").bitwiseAND(F.lit(PREFIX)).cast("int")
    often = shared.groupBy("key").agg(F.count(F.lit(1)).alias("often"))
    held = shared.join(often, "key").join(nodes.select("owner", "level", "needs"), "owner").withColumn("at", level)
    need = F.when(F.col("at") == PREFIX, 1).otherwise(F.get("needs", F.col("at") - F.col("level")))
    own = Window.partitionBy("owner", "at")
    # A row that repeats counts in both numbers, so it only keeps more.
    ranked = held.select(
        "key", "owner", need.alias("need"), F.count(F.lit(1)).over(own).alias("keys"),
        F.row_number().over(own.orderBy("often", "key")).alias("rank"),
    )
    return ranked.where(F.col("rank") <= F.col("keys") - F.col("need") + 1).select("key", "owner")


def _candidate_links(shared: DataFrame) -> DataFrame:
    """Return links (a, b) over which the owners of every key hang together: each one with the smallest, their leader."""
    least = shared.groupBy("key").agg(F.min("owner").alias("leader"))
    links = shared.join(least, "key").where(F.col("owner") != F.col("leader"))
    return links.select(F.col("owner").alias("a"), F.col("leader").alias("b")).distinct()


SETS = "array<struct<owner:bigint,grams:binary>>"


def level_reach(threshold: tuple[int, int]) -> int:
    """Return how many levels above a set a linked larger one can be; small sizes make the largest steps."""
    size = np.arange(1, 4096)
    part, whole = threshold
    return int((fragment_level(size * whole // part, threshold) - fragment_level(size, threshold)).max())


def _block_pairs(blocks: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Return (one, two): the sets of each two blocks of a cluster whose levels allow links.

    Only the blocks' names are paired, in clusters of several blocks; their sets then follow by name.
    """
    key = ["cluster", "level", "block"]
    names = blocks.select(*key)
    below = names.select("cluster", F.col("level").alias("l1"), F.col("block").alias("b1"))
    beside = below.withColumn("level", F.explode(F.sequence("l1", F.col("l1") + level_reach(threshold))))
    pairs = beside.join(names, ["cluster", "level"]).where((F.col("l1") < F.col("level")) | (F.col("b1") < F.col("block")))
    first = blocks.select("cluster", F.col("level").alias("l1"), F.col("block").alias("b1"), F.col("sets").alias("one"))
    second = blocks.select(*key, F.col("sets").alias("two"))
    return pairs.join(first, ["cluster", "l1", "b1"]).join(second, key).select("one", "two")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-copy groups of all documents by 4-word shingles."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
), grams AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [md5(array_to_string(ws, ' '))]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: md5(array_to_string(ws[i:i+3], ' '))) END) AS g FROM docs
), sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM grams x JOIN grams y USING (g)
    WHERE x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * o >= 85 * (p.n + q.n - o)
), reach AS (
  SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT d, b FROM reach JOIN links ON a = r
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(r) AS component_id
FROM documents LEFT JOIN sizes USING (doc_id) JOIN reach ON d = doc_id GROUP BY doc_id, n
"""
