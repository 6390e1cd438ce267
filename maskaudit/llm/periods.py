"""Periodic runs of words: maximal pairs of near occurrences, from the LCP intervals of each text."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskaudit.llm.columns import carried
from maskaudit.llm.hashing import batches

LEAST = 6  # words of a run
EXPONENT = 4  # periods of a run
CHUNK = 1 << 19  # characters of texts whose suffixes are sorted together


def _least_depth(least: int, exponent: int) -> int:
    """Return the smallest number of words that two occurrences of a run share."""
    return min(max(least - p, (exponent - 1) * p) for p in range(1, max(least, 2)))


def _split_classes(old: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Return (new classes, size of each one's class) of suffixes sorted by class and key.

    A class is named by the place of its first suffix among all, so splitting one leaves the names of all others.
    """
    n = len(key)
    fresh = np.concatenate(([True], key[1:] != key[:-1]))
    outer = np.concatenate(([True], old[1:] != old[:-1]))
    at = np.arange(n)
    first = np.maximum.accumulate(np.where(fresh, at, 0))
    begin = np.maximum.accumulate(np.where(outer, at, 0))
    sizes = np.diff(np.append(np.flatnonzero(fresh), n))
    return old + first - begin, sizes[np.cumsum(fresh) - 1]


def repeated_suffixes(words: np.ndarray, end: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort the suffixes that share ``depth`` words or more with another of their text.

    ``words`` are the words of many texts as numbers, none in two texts; ``end`` is where each one's text ends. Returns
    (places, shared), in an order in which suffixes with a common beginning stand together: ``shared[k]`` words are
    common to places k - 1 and k (0 for the first of a class). Classes of suffixes that agree on k words are split by the
    class of what follows, which doubles k; only suffixes that still share a class are sorted again.
    """
    n = len(words)
    active = np.argsort(words, kind="stable")
    classes, sizes = _split_classes(np.zeros(n, dtype=np.int64), words[active])
    levels = [np.empty(n, dtype=np.int32 if n < 2**31 else np.int64)]
    levels[0][active] = classes
    k = 1
    while True:
        if k <= depth:
            kept, kept_sizes = active, sizes
        if 2 * k > depth:
            active = active[sizes > 1]
        if len(active) == 0:
            break
        rank = levels[-1]
        after = active + k
        follows = np.where(after < end[active], rank[np.minimum(after, n - 1)].astype(np.int64) + 1, 0)
        old = rank[active].astype(np.int64)
        key = old * (n + 1) + follows
        order = np.argsort(key, kind="stable")
        active = active[order]
        classes, sizes = _split_classes(old[order], key[order])
        levels.append(rank.copy())
        levels[-1][active] = classes
        k *= 2
    places = kept[kept_sizes > 1]
    places = places[np.argsort(levels[-1][places], kind="stable")]
    if len(places) == 0:
        return places, np.zeros(0, dtype=np.int64)
    one, two = places[:-1], places[1:]
    shared = np.zeros(len(one), dtype=np.int64)
    for level in range(len(levels) - 1, -1, -1):
        a, b = one + shared, two + shared
        inside = (a < end[one]) & (b < end[two])
        same = inside & (levels[level][np.minimum(a, n - 1)] == levels[level][np.minimum(b, n - 1)])
        shared += same.astype(np.int64) << level
    return places, np.concatenate(([0], shared))


def _may_hold_runs(places: np.ndarray, shared: np.ndarray, depth: int, exponent: int) -> np.ndarray:
    """Mark the places of classes (``depth`` words shared) with two occurrences as near as their longest share allows."""
    group = np.cumsum(shared < depth) - 1
    longest = np.maximum.reduceat(shared, np.flatnonzero(shared < depth))
    order = np.lexsort((places, group))
    gap = np.diff(places[order])
    inner = group[order][1:] == group[order][:-1]
    near = np.full(len(longest), np.iinfo(np.int64).max // exponent)
    np.minimum.at(near, group[order][1:][inner], gap[inner])
    return (near * (exponent - 1) <= longest)[group]


def maximal_pairs(places: list[int], shared: list[int], left: list[int], least: int, exponent: int):
    """Yield (start, length, period) of all runs, from LCP intervals visited bottom-up.

    ``shared[k]`` words are common to places k - 1 and k, ``left[x]`` is the class of the word before x. An interval
    holds its occurrences as one ordered list with the left class of each. Where two children of an interval of depth d
    meet, an occurrence of the smaller one is held against its neighbours in the larger one: the words after them
    differ, since they come from two children, and where their left classes differ too, they are a maximal pair. With
    a distance p of at most d / (exponent - 1), the words from the first occurrence to the end of the second are a run of
    period p, and as no occurrence lies between them p is its smallest period: a smaller one would put another there. For
    the same reason neighbours are enough. Merging the smaller into the larger takes O(n log n) steps.
    """
    depth = _least_depth(least, exponent)
    stack: list[list] = []

    def join(one: list[int], two: list[int], d: int, found: list) -> list[int]:
        if len(one) < len(two):
            one, two = two, one
        reach = d // (exponent - 1)
        before = -1
        for x, after in zip(two, [*two[1:], len(left)]):
            at = bisect_left(one, x)
            if at and before < one[at - 1] and x - one[at - 1] <= reach and left[one[at - 1]] != left[x]:
                found.append((one[at - 1], d + x - one[at - 1], x - one[at - 1]))
            if at < len(one) and one[at] < after and one[at] - x <= reach and left[one[at]] != left[x]:
                found.append((x, d + one[at] - x, one[at] - x))
            before = x
        if 8 * len(two) > len(one):
            one += two
            one.sort()
        else:
            for x in two:
                insort(one, x)
        return one

    found: list[tuple[int, int, int]] = []
    current: list[int] = []
    for x, d in zip([*places, -1], [*shared, 0]):
        while stack and stack[-1][0] > d:
            above, members = stack.pop()
            current = join(members, current, above, found)
        if stack and stack[-1][0] == d:
            stack[-1][1] = join(stack[-1][1], current, d, found)
        elif d >= depth:
            stack.append([d, current])
        current = [x]
    return [run for run in found if run[1] >= least]


def runs_of(texts: list[np.ndarray], least: int = LEAST, exponent: int = EXPONENT) -> list[list[tuple[int, int, int]]]:
    """Return the runs (start, length, period) of each text, given as numbers of its words, by start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    counts = np.array([len(t) for t in texts], dtype=np.int64)
    begins = np.concatenate(([0], np.cumsum(counts)))
    if begins[-1] == 0:
        return out
    owner = np.repeat(np.arange(len(texts)), counts)
    words = np.concatenate(texts).astype(np.int64) + begins[owner]  # numbers below the text's length: none in two texts
    depth = _least_depth(least, exponent)
    places, shared = repeated_suffixes(words, begins[owner + 1], depth)
    shared = np.where(shared < depth, 0, shared)
    if len(places) == 0:
        return out
    may = _may_hold_runs(places, shared, depth, exponent)
    places, shared = places[may], shared[may]
    left = np.concatenate(([-1], words[:-1]))
    left[begins[:-1][counts > 0]] = -1
    for start, length, period in maximal_pairs(places.tolist(), shared.tolist(), left.tolist(), least, exponent):
        text = owner[start]
        out[text].append((int(start - begins[text]), length, period))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def _numbered(words: list[bytes]) -> np.ndarray:
    number: dict[bytes, int] = {}
    return np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    covered = np.cumsum(change)
    return b" ".join(w for w, c in zip(words, covered.tolist()) if not c)


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def periodic_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """Find the runs of words that repeat with a period, and collapse them to their first period.

    Words are runs of characters other than space and U+0009 to U+000D, numbered from 0 and told apart by case. A run is a
    stretch of at least ``least`` words and ``exponent`` (3 or more) times its smallest period in which words one
    period apart are the same, and that no neighbouring word extends. Returns the columns of ``docs`` other than ``text``
    and

    - ``n_words``,
    - ``runs``: start, length, period of every run, by start, then period (runs may overlap),
    - ``collapsed``: the words that no run contains after its first period, joined by one space.

    A NULL text and one without words have no runs and an empty ``collapsed``. Rows are worked on one by one, in tasks as
    Spark cuts the table: repeated rows and NULL ids give rows of their own, an empty table gives none, a text of any
    length stays whole. There are no ties: a run is listed once, with its smallest period. See ``carried`` for names
    that clash.
    """
    if exponent < 3:
        raise ValueError("neighbouring occurrences give all runs from three periods on")
    made = ("n_words", "runs", "collapsed")
    others = [docs.schema[c] for c in carried(docs, made)]
    shape = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def find(parts):
        for batch in parts:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for a, b in batches(texts, CHUNK):
                split = [(t or b"").split() for t in texts[a:b]]
                runs = runs_of([_numbered(w) for w in split], least, exponent)
                flat = [r for rs in runs for r in rs]
                values = [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)]
                offsets = np.concatenate(([0], np.cumsum([len(rs) for rs in runs]))).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(values, fields=list(shape.value_type)))
                collapsed = pa.array([_collapsed(w, rs) for w, rs in zip(split, runs)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(f.name).slice(a, b - a) for f in others),
                     pa.array([len(w) for w in split], pa.int64()), listed, collapsed],
                    [*(f.name for f in others), *made],
                )

    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in others]
    return docs.select(*[F.col(f"`{f.name}`") for f in others], F.col("text").cast("string").alias("text")).mapInArrow(
        find, ", ".join([*names, "n_words bigint", f"runs {RUNS}", "collapsed string"])
    )


BLANKS = r"[\x20\x09-\x0D]+"


def _made_periodic(doc_id, text):
    """Return ``text``, in a tenth of the documents with a tail that repeats its first words."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeat(w):
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        times = (F.floor((n - a) / p) + 1).cast("int")
        tail = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), times)), F.lit(1), n - a)
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a), tail), " ")).otherwise("")

    words = F.array_remove(F.split(text, BLANKS), "")
    # The array of one element binds the words, which are used several times.
    return F.when(h % 10 == 0, F.transform(F.array(words), repeat)[0]).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, some of which are given a periodic tail first: the longest one, and digests of all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = periodic_runs(docs.select("doc_id", _made_periodic(F.col("doc_id"), F.col("text")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-best["s"]).alias("start"), best["n"].alias("length"),
        (-best["p"]).alias("period"), F.floor(1000 * best["n"] / -best["p"]).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


OP13_SQL = r"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT for c in string_split(doc_id::VARCHAR, '')]),
      lambda crc, c: list_reduce(list_prepend(xor(crc, c), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS h
  FROM documents
), sized AS MATERIALIZED (
  SELECT rid, doc_id, len(w) AS n, coalesce(h % 10 = 0, FALSE) AND len(w) > 0 AS made,
    CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a, h // 10 AS g FROM docs
), plan AS MATERIALIZED (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM sized),
given AS MATERIALIZED (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM docs),
words AS MATERIALIZED (
  SELECT rid, x.i, y.word, n FROM given x JOIN plan USING (rid)
  JOIN given y USING (rid) WHERE y.i = CASE WHEN made AND x.i >= a THEN a + (x.i - a) % p ELSE x.i END
), grams AS MATERIALIZED (
  SELECT rid, i, n, word || ' ' || lead(word) OVER s || ' ' || lead(word, 2) OVER s || ' ' || lead(word, 3) OVER s
    || ' ' || lead(word, 4) OVER s AS gram
  FROM words WINDOW s AS (PARTITION BY rid ORDER BY i)
), pairs AS (
  SELECT x.rid, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.rid = y.rid AND x.gram = y.gram
    AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), marked AS (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM pairs),
stretches AS (
  SELECT rid, q, min(i) AS start, count(*) + 4 + q AS length FROM marked GROUP BY rid, q, island
  HAVING count(*) + 4 + q >= greatest(6, 4 * q)
), runs AS MATERIALIZED (SELECT rid, start, length, min(q) AS period FROM stretches GROUP BY rid, start, length),
gone AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT rid, sha256(string_agg(word, ' ' ORDER BY i)) AS digest FROM words ANTI JOIN gone USING (rid, i) GROUP BY rid
), listed AS (
  SELECT rid, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS digest
  FROM runs GROUP BY rid
), best AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length DESC, start, period) = 1
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length,
  period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
  coalesce(listed.digest, sha256('')) AS runs_sha256, coalesce(kept.digest, sha256('')) AS collapsed_sha256
FROM sized LEFT JOIN listed USING (rid) LEFT JOIN best USING (rid) LEFT JOIN kept USING (rid)
"""
