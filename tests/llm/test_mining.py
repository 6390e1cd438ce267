"""Hard negatives, minimum bin slack and periodic runs against brute force, with hostile rows."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskaudit.llm import negatives, packing, periods, slack


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, anchor string, _x int")


def hostile_vectors():
    rng = random.Random(11)
    rows = []
    for i in range(700):
        width = 3 if i % 50 == 7 else 6
        label = None if i % 31 == 5 else (1 if i < 250 else rng.randrange(6))
        x = [round(rng.uniform(-1, 2), 1) for _ in range(width)]
        if i % 41 == 3:
            x = [0.5] * width  # ties
        rows.append((i, x, label, "a", 1))
    rows += [(800, None, 1, "a", 1), (900, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1, "a", 1), (1000, [float("nan")] * 6, 1, "a", 1)]
    rows += [(1100, [float("inf")] * 6, 2, "a", 1), (1200, [], 2, "a", 1), (None, [1.0] * 6, 2, "a", 1), (1300, [1e30] * 6, 3, "a", 1)]
    rows += [(1400, [1.0] * 6, 9, None, None), (601, [1.0] * 6, 2, "a", 1), (601, [1.0] * 6, 2, "a", 1), (300, [1.5] * 6, 0, "a", 1)]
    return rows


def mined(rows, positives=5, negatives_=10):
    usable = [(i, y, [int(np.floor(256 * float(np.float32(c)))) for c in x]) for i, x, y, *_ in rows
              if i is not None and y is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)]
    cap = 2**63 - 1
    usable = [(i, y, [max(-cap - 1, min(cap, c)) for c in x]) for i, y, x in usable]
    anchors = {}
    for i, y, x in usable:
        if i % 100 == 0 and (i not in anchors or (y, x) < anchors[i]):
            anchors[i] = (y, x)
    out = []
    for a, (label, x) in anchors.items():
        scored = sorted((-max(-cap, min(cap, sum(p * q for p, q in zip(x, z)))), i, y) for i, y, z in usable if i != a and len(z) == len(x))
        for s, p, _ in [r for r in scored if r[2] == label][:positives]:
            fit = [(i, -t) for t, i, y in scored if y != label and -30 * s <= -100 * t <= -90 * s][:negatives_]
            out += [(a, p, k + 1, i, -s, t) for k, (i, t) in enumerate(fit)]
    return sorted(out)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("blocks", [(1024, 2048, 4), (3, 17, 1)])
def test_hard_negatives_are_those_of_all_scores(spark, monkeypatch, blocks):
    for name, value in zip(("ANCHORS", "ROWS", "GROUP"), blocks):
        monkeypatch.setattr(negatives, name, value)
    rows = hostile_vectors()
    table = vectors(spark, rows).repartition(3)
    usable = negatives.usable(table, F.col("label"), lambda x: F.floor(256 * x))
    got = negatives.hard_negatives(usable, F.col("id") % 100 == 0).select(COLUMNS)
    assert dict(got.dtypes)["rank"] == "int"
    want = mined(rows)
    assert len({r[0] for r in want}) > 5 and any(r[1] == 1300 for r in want) or len(want) > 100
    assert sorted(map(tuple, got.collect())) == want
    none = negatives.hard_negatives(usable.limit(0), F.col("id") % 100 == 0)
    assert none.count() == 0


def test_inner_products_are_exact():
    x = np.array([[2**31 - 1, -5], [3, 2**40]], dtype=np.int64)
    assert negatives.inner_products(x, x).tolist() == [[int(p) * int(r) + int(q) * int(s) for r, s in x] if k == 0 else
                                                       [3 * (2**31 - 1) - 5 * 2**40, 2**63 - 1] for k, (p, q) in enumerate(x)]


def test_best_of_breaks_ties_by_column():
    rng = np.random.default_rng(1)
    for _ in range(200):
        s = rng.integers(-2, 3, (4, rng.integers(0, 12)))
        s = np.where(rng.random(s.shape) < 0.2, negatives.NOTHING, s)
        i, j = negatives.best_of(s, 3)
        for row in range(4):
            ranked = sorted((-int(v), c) for c, v in enumerate(s[row]) if v != negatives.NOTHING)[:3]
            assert j[i == row].tolist() == [c for _, c in ranked]


def test_fullest_combination_and_bins():
    rng = random.Random(12)
    for _ in range(400):
        room = rng.randint(1, 40)
        sizes = [rng.randint(1, room) for _ in range(rng.randint(0, 9))]
        counts = [sizes.count(n) for n in range(room + 1)]
        total, chosen = slack.fullest(sorted(set(sizes)), counts, room)
        sums = {sum(c) for k in range(len(sizes) + 1) for c in itertools.combinations(sizes, k)}
        assert total == max(s for s in sums if s <= room) == sum(n * k for n, k in chosen)
        bins, offsets, count = slack.minimum_slack(np.array(sizes, dtype=np.int64), room)
        for b in range(count):
            own = sorted((int(o), n) for o, n, x in zip(offsets, sizes, bins) if x == b)
            assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
            assert 0 < sum(n for _, n in own) <= room
        left = list(sizes)
        for b in range(count):  # every bin is the fullest one of what was left
            own = [n for n, x in zip(sizes, bins) if x == b]
            assert sum(own) == max(s for s in {sum(c) for k in range(len(left) + 1) for c in itertools.combinations(left, k)} if s <= room)
            for n in own:
                left.remove(n)


def test_few_bins_where_pieces_fill_each_other():
    sizes = np.random.default_rng(3).integers(400, 900, 8000)
    _, _, count = slack.minimum_slack(sizes)
    assert count <= 1.01 * sizes.sum() / slack.SIZE
    lengths = np.random.default_rng(3).exponential(900, 8000).astype(np.int64) % slack.SIZE + 1
    assert slack.minimum_slack(lengths)[2] <= lengths.sum() // slack.SIZE + 4


TEXTS = [
    "plain words", None, "", " \n\t", "naïve café 中文字 <|endoftext|> x", "a " * 9000, "<|endoftext|>", "x" * 5000 + "\x00",
    " ".join(f"w{i}" for i in range(3000)), "tail", "tail",
]


def test_tight_packing_round_trip(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.vocabulary())
    rows = [(k, t, 2.5, "s") for k, t in enumerate(TEXTS)] + [(None, "no id", 2.5, "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, Offset double, source string").repartition(2)
    got = slack.pack_tight(docs, packing.vocabulary(), pool=5000)
    assert [c.lower() for c in got.columns].count("offset") == 1 and "source" in got.columns
    documents, sequences = {}, {}
    for r in got.collect():
        documents.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], np.frombuffer(r["ids"], dtype="<u4").tolist()))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for k, text, *_ in rows:
        want = plain.encode(text or "", add_special_tokens=False).ids + [packing.END]
        pieces = sorted(documents[k])
        assert [p[0] for p in pieces] == list(range(len(pieces))) and sum((p[3] for p in pieces), []) == want
        assert [p[1] for p in pieces] == [sum(q[2] for q in pieces[:n]) for n in range(len(pieces))]
        assert all(p[2] == len(p[3]) for p in pieces) and all(p[2] == slack.SIZE for p in pieces[1:])
        assert len(pieces) == 1 or pieces[0][2] == (len(want) % slack.SIZE or slack.SIZE)
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= slack.SIZE
    assert slack.pack_tight(docs.limit(0), packing.vocabulary()).count() == 0


def all_runs(words, least=6, exponent=4):
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def some_words(rng):
    words = []
    kinds = rng.choice([1, 2, 2, 3, 5])
    for _ in range(rng.randint(0, 6)):
        unit = [rng.choice(["a", "A", "é", "b.", "b"][:kinds]) for _ in range(rng.randint(1, 7))]
        words += (unit * rng.randint(1, 9))[: rng.randint(1, 60)]
    return words


@pytest.mark.parametrize("least,exponent", [(6, 4), (2, 3), (9, 3), (6, 5)])
def test_runs_are_all_runs(least, exponent):
    rng = random.Random(13)
    for _ in range(300):
        texts = [some_words(rng) for _ in range(rng.randint(1, 5))]
        got = periods.runs_of([periods._numbered([w.encode() for w in t]) for t in texts], least, exponent)
        assert got == [all_runs(t, least, exponent) for t in texts]


@pytest.mark.parametrize("words", [["a"] * 200_000, ["a", "b"] * 100_000, [str(i % 997) for i in range(200_000)]])
def test_a_long_text_of_one_run(words):
    period = len(set(words))
    assert periods.runs_of([periods._numbered([w.encode() for w in words])]) == [[(0, len(words), period)]]


def test_two_periods_are_refused(spark):
    with pytest.raises(ValueError):
        periods.periodic_runs(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), 6, 2)


def test_op13_digests(spark, tmp_path):
    rng = random.Random(14)
    texts = [None, "", " \n", "one", "a\x1cb a\x1cb", "x\x85y " * 8, "\x0b\x0c a a a a a a \r\n"]
    texts += [rng.choice([" ", "\n", "  \t"]).join(some_words(rng)) for _ in range(200)] + ["q r s t " * 3000]
    rows = [(k, t, 7, [1]) for k, t in enumerate(texts)] + [(None, "a " * 9, 7, None), (3, "again", None, None), (3, "again", None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, Runs int, other array<int>").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = periods.op13_periodic_runs(spark, str(tmp_path)).collect()
    want = []
    for doc_id, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n = len(words)
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = all_runs(words)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = min(((-m, s, q) for s, m, q in runs), default=None)
        longest = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        digests = ["".join(f"{s},{m},{q}\n" for s, m, q in runs), " ".join(w for i, w in enumerate(words) if i not in gone)]
        want.append((doc_id, len(runs), *longest, *[hashlib.sha256(d.encode()).hexdigest() for d in digests]))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert sum(w[1] for w in want) > 200
    found = periods.periodic_runs(docs)
    assert found.columns == ["doc_id", "other", "n_words", "runs", "collapsed"]
    assert periods.periodic_runs(docs.limit(0)).count() == 0


def test_a_tiny_share_of_the_training_text_still_teaches(spark):
    from maskaudit.llm import langid

    texts = spark.range(4_000_000, numPartitions=8).select(F.lit("xx").alias("lang"), F.concat(F.lit("ein zug "), F.col("id").cast("string")).alias("text"))
    chars = texts.agg(F.sum(F.length("text"))).first()[0]
    kept = [r["text"] for r in langid._bounded(texts, 45, "fit").collect()]
    assert 45 / chars < 1e-6 and 0 < len(kept) < 20
    small = texts.limit(50)
    assert langid._bounded(small, 10**9, "fit").count() == 50


def test_a_common_phrase_is_no_copy_of_a_short_item(spark):
    from maskaudit.llm import decontamination

    items = [(1, "What is the capital"), (2, "Which of the following is correct"), (3, "name the seven highest hills of old Rome now")]
    docs = [
        (1, "She asked what is the matter with him."), (2, "Which of the following roads goes north is unclear"),
        (3, "he could name the seven highest dunes here"), (11, "so: what is the capital of it"),
        (12, "which of the following is correct or not"), (13, "name the seven highest hills of young Rome now"),
    ]
    found = decontamination.find_passages(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    )
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(11, 1), (12, 2), (13, 3)}


def test_a_phrase_of_many_items_costs_little_and_hides_no_copy(spark):
    import time

    from maskaudit.llm import decontamination

    rng = random.Random(21)
    vocabulary = ["w%d" % i for i in range(5000)]
    phrase = ["which", "of", "the", "following"]
    texts = [" ".join(phrase + rng.choices(vocabulary, k=25)) for _ in range(2000)]
    items = decontamination.index_items(list(range(2000)), texts)
    body = []
    for k in range(200):
        body += rng.choices(vocabulary, k=100) + phrase
        if k % 40 == 3:
            copy = texts[k].split()
            copy[5::6] = ["new"] * len(copy[5::6])
            body += copy
    start = time.process_time()
    found = decontamination._aligned([" ".join(body), "short one", None], items, 3, 0.5)
    assert {(t, i) for t, i, *_ in found} == {(0, k) for k in range(3, 200, 40)}
    assert time.process_time() - start < 20


def test_marks_and_single_characters_are_told_apart_as_by_patterns():
    from maskaudit.llm import decontamination

    marks, singles = decontamination._apart()
    rng = random.Random(22)
    alphabet = list("ab é ß“”—。中文กข\x85 ひ\U00020001")
    for _ in range(500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 20)))
        plain = "".join(" " if c in marks else c for c in text)
        assert decontamination._spaced(text).split() == singles.sub(r" \g<0> ", plain).split()
