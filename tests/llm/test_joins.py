"""Near-copy groups, embedding groups and components against brute force, with hostile rows."""

import glob
import itertools
import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maskaudit.llm import embeddings, jaccard
from maskaudit.llm.components import connected_components
from maskaudit.llm.scratch import WRITING, Scratch


def groups(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(1, 7)] + [(50, 50), (60, 61), (61, 60), (60, 61)]
    links += [(200 + i, 200 + (i * 7) % 31) for i in range(31)]
    want = groups({n for link in links for n in link}, links)
    rows = spark.createDataFrame([*links, (None, 3), (4, None)], "a bigint, b bigint")
    got = connected_components(rows, Scratch(spark)).collect()
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)
    assert connected_components(rows.limit(0), Scratch(spark)).count() == 0


def test_a_table_is_written_in_small_batches_and_leaves_no_exchange(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["size"])

    def exchanged():
        folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {f for folder in folders for f in glob.glob(f"{folder}/*/shuffle_*.data")}

    before = {key: spark.conf.get(key) for key in WRITING}
    held = exchanged()
    texts = spark.range(0, 4000, 1, 1).selectExpr("repeat(cast(id + 1000 as string), 1000) as text")
    sent = Scratch(spark).put(texts.repartition(1, "text").mapInArrow(sizes, "size bigint"))
    end = time.time() + 20
    while exchanged() - held and time.time() < end:
        time.sleep(0.2)
    assert not exchanged() - held
    assert 15e6 < sent.agg({"size": "sum"}).first()[0] and sent.agg({"size": "max"}).first()[0] < 5e6
    assert {key: spark.conf.get(key) for key in WRITING} == before


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + 4]) for i in range(max(len(words) - 3, min(len(words), 1)))}


def near_copies(rng):
    words = ["w%d" % i for i in range(300)] + ["É", "é", "a b", "x\x1cy", "Don't"]
    texts = [None, "", " \n\t", "one", "ONE", "one two", "one\ttwo ", "a b c d", "A B c d e"]
    common = " ".join(rng.choices(words, k=40))
    for size in (3, 5, 9, 14, 30, 60, 120, 400):
        for _ in range(3):
            base = rng.choices(words, k=size)
            for _ in range(8):
                copy = list(base)
                for _ in range(rng.randint(0, max(1, size // 40))):
                    copy[rng.randrange(len(copy))] = rng.choice(words)
                texts.append(" ".join(copy))
            texts.append(" ".join(base) + " " + common)
            texts.append(" ".join(base).upper())
    return texts + texts[20:30]


def test_overlaps_sum_over_fragments():
    rng = random.Random(13)
    sets = [np.unique(np.array([rng.randrange(200) for _ in range(rng.randint(0, 60))], dtype=np.uint64)) for _ in range(14)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets[6:]] for a in sets[:6]]
    assert all(jaccard.overlaps(sets[:6], sets[6:], cut).tolist() == want for cut in (1, 7, 4096))


@pytest.mark.parametrize(("seed", "block"), [(1, 256), (2, 1)])
def test_jaccard_groups_equal_all_pairs(spark, monkeypatch, seed, block):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    texts = near_copies(random.Random(seed)) + ["p q r s t u v w x", "p q r s t u v w x y", "p q r s t u v w"]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(texts)], "doc_id int, text string, n int, owner string")
    sets = [shingles(t) for t in texts]
    links = [
        (a, b) for a, b in itertools.combinations(range(len(texts)), 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    ]
    want = groups(range(len(texts)), links)
    got = jaccard.jaccard_components(docs.repartition(5)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {
        i: (len(sets[i]), want[i]) for i in range(len(texts))
    }
    assert len(got) == len(texts)


def test_sets_that_fill_enough_fragments_put_out_no_prefix():
    rng, threshold = np.random.default_rng(3), (80, 100)
    sizes = rng.integers(200, 3000, 300)
    values = np.concatenate([np.sort(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in sizes])
    keys, owners = jaccard._fragment_keys(values, np.concatenate(([0], np.cumsum(sizes))), threshold)
    assert len(set(owners.tolist())) == len(sizes)
    assert not ((keys >> np.uint64(32)) % np.uint64(64) == jaccard.PREFIX).any()


def passage_groups(rng, number, copies=3):
    """Groups of near copies; half of every text is a passage that all texts have in common."""
    words = [f"w{i}" for i in range(5000)]
    passage, rows, want = rng.choices(words, k=170), [], {}
    for i in range(number):
        own = rng.choices(words, k=170)
        for j in range(copies):
            rows.append((copies * i + j, " ".join([*passage, *own, *(f"more{x}" for x in range(j))])))
            want[copies * i + j] = copies * i
    return rows, want


def test_a_passage_of_all_texts_does_not_make_them_one_cluster(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 8)
    links, compared = jaccard._links, []

    def counted(rows, threshold):
        compared.append(sum(len(r["one"]) + len(r["two"] or []) for r in rows.collect()))
        return links(rows, threshold)

    monkeypatch.setattr(jaccard, "_links", counted)

    def run(number):
        compared.clear()
        rows, want = passage_groups(random.Random(11), number)
        got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == want
        return sum(compared)

    few, many = run(20), run(60)
    assert 60 <= few <= 200 and many <= 4 * few


@pytest.mark.parametrize("threshold", [(85, 100), (80, 100)])
def test_linked_sets_share_a_key_that_is_kept(spark, threshold):
    rng = random.Random(5)
    rows, _ = passage_groups(rng, 6, 4)
    rows += [(100 + i, t) for i, t in enumerate(near_copies(rng)) if shingles(t)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    own = jaccard.members(docs, 4, threshold)
    nodes = own.groupBy("owner").agg(*[F.first(c).alias(c) for c in ("n", "level", "needs")])
    shared = jaccard.shared_keys(docs, 3, 4, threshold)
    kept = {}
    for r in jaccard._rarest(shared, nodes).collect():
        kept.setdefault(r["owner"], set()).add(r["key"])
    owner = {r["doc_id"]: r["owner"] for r in own.collect()}
    sets = {i: shingles(t) for i, t in rows}
    linked = [
        (a, b) for a, b in itertools.combinations(sets, 2)
        if owner[a] != owner[b] and threshold[1] * len(sets[a] & sets[b]) >= threshold[0] * len(sets[a] | sets[b])
    ]
    assert len(linked) > 50 and all(kept.get(owner[a], set()) & kept.get(owner[b], set()) for a, b in linked)
    assert sum(map(len, kept.values())) < 0.8 * shared.distinct().count()


def test_a_dense_group_of_many_blocks_is_joined(spark, monkeypatch):
    copies = 40
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 4)
    monkeypatch.setattr(jaccard, "BLOCK_GRAMS", 1500)
    words = [f"w{i}" for i in range(300)]
    rows = [(100 - i, " ".join([*words, f"x{i}"])) for i in range(copies)] + [(7, "something else again and again")]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {100 - i: 101 - copies for i in range(copies)} | {7: 7}


def test_jaccard_of_repeated_and_missing_ids(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(5, text), (5, text), (3, text + " more"), (3, "else " * 9), (None, text), (None, None)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in got if r["doc_id"]) == [(3, 3), (3, 3), (5, 3), (5, 3)]
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None, None]
    assert jaccard.jaccard_components(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(y * y for y in b))


def test_embedding_groups_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    monkeypatch.setattr(embeddings, "LEAF", 4)
    rng = random.Random(3)
    rows = []
    for label in (0, 1, None):
        for _ in range(12):
            base = [rng.gauss(0, 1) for _ in range(8)]
            for _ in range(rng.randint(1, 8)):
                rows.append(([x + rng.gauss(0, 0.18) for x in base], label))
    rows += [rows[0], rows[0], ([2 * x for x in rows[1][0]], 0), ([0.0] * 8, 0), ([0.0] * 8, 0), (None, 0), ([], 0)]
    rows += [([float("nan")] + [1.0] * 7, 0), ([None] + [1.0] * 7, 0), ([float("inf")] + [1.0] * 7, 0), ([1.0, 2.0], 0), ([1.0, 2.01], 0)]
    rows += [([1e30 * x for x in rows[2][0]], 0)]
    rows = [(100 - i, e, label, "x") for i, (e, label) in enumerate(rows)]
    sound = {
        v: (e, label) for v, e, label, _ in rows
        if label is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)
    }
    links = [
        (a, b) for a, b in itertools.combinations(sound, 2)
        if sound[a][1] == sound[b][1] and len(sound[a][0]) == len(sound[b][0]) and cosine(sound[a][0], sound[b][0]) >= 0.93
    ]
    want = groups([r[0] for r in rows], links)
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int, node string")
    got = embeddings.near_duplicates(table.repartition(3)).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {
        v: (sum(v in link for link in links), want[v], want[v] == v) for v in want
    }
    assert len(got) == len(rows) and len(links) > 50
    assert embeddings.near_duplicates(table.limit(0)).count() == 0


def test_embedding_plan_pairs_no_rows_without_a_key(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [1.0, 2.1], 1)], "vec_id bigint, embedding array<double>, label int")
    plan = embeddings.near_duplicates(table)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
