"""Chat formatting, packing, token counts, languages, decontamination and the pipeline, with hostile rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from maskaudit.llm import chat, decontamination, hashing, langid, packing, tokens

HARD = [
    None, "", " ", "\n\n", "a", "plain words here", "two  spaces\n and lines \n\n", "É à ñ ß œ 中文 \U0001f600", "x" * 5000,
    "<|endoftext|> [INST] </s>", "it's 12,345.67 don't", "\x1c\x85 　", "word " * 3000,
]


def hard_docs(spark, **more):
    rows = [(i, t, 1, "x", 2.0) for i, t in enumerate(HARD)] + [(1, "", 1, "x", 2.0), (None, "no id", 1, "x", 2.0)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, start int, Score string, n_words double")


# --- chat


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "\\", "\\\\<s>", "<\\s>", "[/INST", "<<SYS>>\n<</SYS>>", "<", "", None, "\n", "[ROLE]x[/ROLE]",
             "<s", "\\<s>\\", "end <", "\U0001f600\\[INST]"]
    roles = ["user", "assistant", "system", "tool", "[INST]", "", None, "a\\b", "Assistant"]
    rng = random.Random(4)
    rows = [(c, t, rng.choice(roles), rng.choice(texts)) for c in range(60) for t in range(rng.randint(1, 6))]
    rows += [(None, 0, "user", "hi"), (77, None, "user", "a"), (77, 1, "assistant", "b"), (77, 1, "assistant", "b")]
    table = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").withColumn("formatted", F.lit(1))
    out = chat.format_conversations(table).withColumn("back", chat.read_back(F.col("formatted"))).collect()
    want = {}
    for c, t, r, x in rows:
        want.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    assert {r["conv_id"]: [(t["role"], t["text"]) for t in r["back"]] for r in out} == {
        c: [x[1:] for x in sorted(turns)] for c, turns in want.items()
    }
    controls = [c for c in chat.DEFAULT.controls()]
    for r in out:
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        assert sum(s["loss"] for s in r["segments"]) == sum(t["role"] == "assistant" for t in r["back"])
        for s in r["segments"]:
            if s["loss"]:
                assert not any(c in s["text"] for c in controls)
    assert chat.format_conversations(table.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("roles", "fault"),
    [("ua", None), ("sua", None), ("uaua", None), ("u", 2), ("au", 1), ("suu", 3), ("uas", 3), ("ss", 2), ("ut", 2), ("uau", 4)],
)
def test_role_machine(spark, roles, fault):
    names = {"u": "user", "a": "assistant", "s": "system", "t": "tool"}
    rows = [(1, i, names[r], "x") for i, r in enumerate(roles)]
    got = chat.format_conversations(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).first()
    assert (got["valid"], got["first_fault"]) == (fault is None, fault)


def test_templates_that_cannot_be_read_back_are_refused():
    with pytest.raises(ValueError, match="read back"):
        chat.Template({"user": chat.Turn("<a>", "a><b")}, ("[R]", "[T]", "[E]<a"), {}, ())


# --- packing


def test_best_fit_decreasing_equals_plain_search():
    rng = random.Random(5)
    for _ in range(200):
        lengths = np.array([rng.randint(1, 32) for _ in range(rng.randint(0, 60))], dtype=np.int64)
        window, offset, count = packing.best_fit_decreasing(lengths, 32)
        room: list[int] = []
        for k in np.argsort(-lengths, kind="stable"):
            fits = [(r, j) for j, r in enumerate(room) if r >= lengths[k]]
            if fits:
                room[min(fits)[1]] -= lengths[k]
            else:
                room.append(32 - lengths[k])
        assert count == len(room)
        for w in range(count):
            own = sorted((int(o), int(n)) for o, n, x in zip(offset, lengths, window) if x == w)
            assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 32


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.vocabulary())
    plain.encode_special_tokens = True
    rows = packing.pack(hard_docs(spark).repartition(2), packing.vocabulary(), pool=4000).collect()
    docs, sequences = {}, {}
    for r in rows:
        ids = np.frombuffer(r["ids"], dtype="<u4")
        assert len(ids) == r["length"] <= packing.WINDOW and r["n_words"] == 2.0
        docs.setdefault(r["doc_id"], []).append((r["start"], ids.tolist(), r["doc_tokens"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, text in [*enumerate(HARD), (None, "no id")]:
        want = plain.encode(text or "", add_special_tokens=False).ids + [packing.END]
        got = sorted(docs[i])
        if i == 1:  # the row that repeats
            assert got == [(0, [0], 1)] * 2
            continue
        assert sum((g[1] for g in got), []) == want and all(g[2] == len(want) for g in got)
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= packing.WINDOW
    assert packing.pack(hard_docs(spark).limit(0), packing.vocabulary()).count() == 0


def test_both_encoders_agree():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.vocabulary())
    plain.encode_special_tokens = True
    encoder = packing._encoder(packing.vocabulary())
    rng = random.Random(6)
    alphabet = ["a", "B", " ", "  ", "\n", "\t", "é", "12", "'s", "'LL", "\xa0", "\x85", "<|endoftext|>", "²", "ª", "中", "_", "\x00"]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(encoder.encode(text), dtype="<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_added_tokens_have_their_own_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.vocabulary())
    encoder = packing._encoder(packing.vocabulary(), True)
    assert np.frombuffer(encoder.encode("a <|endoftext|> b"), dtype="<u4").tolist() == [64, 220, 50256, 275]
    rng = random.Random(15)
    alphabet = ["a", " ", "\n", "é", "12", "'s", "<|endoftext|>", "<|endoftext|", ">", "<|", "中", "\x00"]
    for _ in range(2000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(encoder.encode(text), dtype="<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    hard_docs(spark).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in packing.op4_packing(spark, str(tmp_path)).where("doc_tokens < 1024").collect()}
    for i in (7, 9, 10):
        ids = np.array(plain.encode(HARD[i], add_special_tokens=False).ids + [packing.END], dtype="<u4")
        assert rows[i]["ids_crc32"] == zlib.crc32(ids.tobytes()) and rows[i]["doc_tokens"] == len(ids)


# --- token counts


def greedy(pieces, word):
    count, at = 0, 0
    while at < len(word):
        size = next((n for n in range(len(word) - at, 0, -1) if word[at : at + n] in pieces), 0)
        if not size:
            return 1
        count, at = count + 1, at + size
    return count


def test_automaton_equals_greedy_search():
    rng = random.Random(7)
    for _ in range(800):
        pieces = {bytes(rng.choice(b"ab ") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 9))}
        automaton = tokens.Automaton(sorted(pieces))
        for _ in range(20):
            word = bytes(rng.choice(b"abc ") for _ in range(rng.randint(0, 14)))
            assert automaton.count(word) == greedy(pieces, word)


def test_token_counts_of_hard_texts(spark):
    pieces = set(tokens.byte_pieces(packing.vocabulary()))
    got = tokens.count_tokens(hard_docs(spark), packing.vocabulary()).collect()
    for r in got:
        text = "no id" if r["doc_id"] is None else HARD[r["doc_id"]] or ""
        words = text.encode().split()
        assert r["n_words"] == len(words) and r["start"] == 1
        if r["doc_id"] != 8:
            assert r["n_tokens"] == sum(greedy(pieces, b" " + w) for w in words)
    assert tokens.count_tokens(hard_docs(spark).limit(0), packing.vocabulary()).count() == 0


# --- languages


def test_kneser_ney_sums_to_one():
    rng = random.Random(8)
    texts = {x: ["".join(rng.choice(a) for _ in range(400))] for x, a in (("p", "abc "), ("q", "bcd  é"))}
    counts = {}
    for lang, own in texts.items():
        for points, _, runs in langid._pieces(own):
            gram, n = np.unique(langid._grams(points, runs)[0], return_counts=True)
            counts[lang] = (gram, n)
    model = langid.kneser_ney(counts)
    letters = [ord(c) for c in "abcdé "]
    for context in ("abc", "bcd", "   ", "zzz", "dé ", "zab"):
        high = sum(ord(c) << (16 * (3 - k)) for k, c in enumerate(context))
        grams = np.array([high | x for x in letters], dtype=np.uint64)
        p = np.exp(model.log_probability(grams).astype(float))
        unknown = np.exp(model.log_probability(np.array([high | 0x4E2D], dtype=np.uint64)).astype(float))
        assert np.allclose(p.sum(axis=0) + unknown[0], 1.0, atol=1e-5)


def samples(n):
    rng = random.Random(9)
    words = {"xx": ["zug", "ber", "sch", "und", "tzen"], "yy": ["ola", "que", "ion", "los", "amo"]}
    return [(i, " ".join(rng.choice(words[x]) for _ in range(60)), x) for i in range(n) for x in [("xx", "yy")[i % 2]]]


def test_language_of_held_out_texts(spark):
    rows = samples(120) + [(900, None, "xx"), (901, "", "yy"), (902, "12 34 !", None), (903, "Ολα ειναι καλα " * 20, None), (904, "Zug", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("score", F.lit("clash"))
    model = langid.fit_on_documents(docs)
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["lang_pred"] == x and not got[i]["rejected"] and 0 <= got[i]["score"] <= 1 for i, _, x in samples(120))
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3
    assert got[903]["rejected"] and got[904]["lang_pred"] == "xx" and not got[904]["rejected"]
    kept = {r["doc_id"] for r in langid.accepted(docs, model).collect()}
    assert kept == {i for i, r in got.items() if not r["rejected"]}
    empty = docs.limit(0)
    assert langid.identify(docs, langid.fit(empty, empty)).where("lang_pred <> 'und'").count() == 0
    assert langid.identify(empty, model).count() == 0


def test_long_texts_are_scored_whole(monkeypatch):
    counts = {}
    for points, _, runs in langid._pieces([samples(1)[0][1]]):
        counts["xx"] = np.unique(langid._grams(points, runs)[0], return_counts=True)
    model = langid.kneser_ney(counts)
    text = samples(1)[0][1] * 30
    whole = model.entropies([text, "zug", text])
    monkeypatch.setattr(langid, "CHUNK", 97)
    parts = model.entropies([text, "zug", text])
    assert np.allclose(whole[1], parts[1], rtol=0.005) and abs(whole[0] - parts[0]).max() <= len(text) // 97


# --- decontamination


def smith_waterman(a, b):
    row, best = [0] * (len(b) + 1), 0
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(max(0, row[j - 1] + (2 if x == y else -1), row[j] - 1, new[-1] - 1))
        row, best = new, max(best, *new)
    return best


def test_alignment_equals_plain_smith_waterman():
    rng = random.Random(10)
    items = [np.array([rng.randint(1, 5) for _ in range(rng.randint(1, 15))], dtype=np.uint64) for _ in range(200)]
    windows = [np.array([rng.randint(1, 5) for _ in range(rng.randint(0, 30))], dtype=np.uint64) for _ in range(200)]
    value, begin, end = decontamination.align(items, windows)
    for k in range(200):
        assert value[k] == smith_waterman(items[k], windows[k])
        assert smith_waterman(items[k], windows[k][begin[k] : end[k]]) == value[k]


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def test_copies_and_edited_copies_are_found(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(4000)]
    common = ["the", "of", "and"]
    items = [(i, " ".join(rng.choice(vocabulary + common * 200) for _ in range(rng.randint(12, 40)))) for i in range(20)]
    fill = lambda n: [rng.choice(vocabulary + common * 200) for _ in range(n)]
    docs, planted = [], {}
    for d in range(120):
        words = fill(rng.randint(0, 300))
        if d % 2:
            i, text = rng.choice(items)
            copy = text.split()
            for _ in range(len(copy) // 7 if d % 4 == 1 else 0):
                k = rng.randrange(len(copy))
                copy[k : k + 1] = rng.choice([[], [rng.choice(vocabulary)], [copy[k], rng.choice(vocabulary)]])
            words[len(words) // 2 : len(words) // 2] = copy
            planted[d] = i
        docs.append((d, " ".join(w.capitalize() + "," if rng.random() < 0.2 else w for w in words)))
    docs += [(500, None), (501, ""), (3, docs[3][1]), (None, items[0][1])]
    table = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("Score", F.lit("clash"))
    bench = spark.createDataFrame([*items, items[0], (90, None), (91, "the of"), (None, "x y z")], "item_id bigint, text string")
    got = decontamination.find_passages(table, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got if r["doc_id"] is not None} == set(planted.items())
    assert sum(r["doc_id"] == 3 for r in got) == 2 and sum(r["doc_id"] is None for r in got) == 1
    texts, targets = dict(docs), dict(items)
    for r in got:
        text, item = words_of(texts[r["doc_id"]]), words_of(targets[r["item_id"]])
        span = text[r["first_word"] : r["end_word"]]
        assert r["score"] == smith_waterman(item, span) / (2 * len(item)) == smith_waterman(item, text) / (2 * len(item))
    kept = decontamination.without_passages(table, bench)
    assert kept.columns == table.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs if d is not None and d not in planted}
    assert decontamination.find_passages(table, bench.limit(0)).count() == 0
    assert decontamination.find_passages(table.limit(0), bench).count() == 0


@pytest.mark.parametrize("every", [5, 4, 3])
def test_heavily_edited_copies_are_found_like_by_full_alignment(spark, every):
    rng = random.Random(every)
    vocabulary = ["w%d" % i for i in range(3000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(12, 60)))) for i in range(12)]
    docs = []
    for i, text in items:
        regular, loose = text.split(), text.split()
        regular[every - 1 :: max(every, 4)] = ["new"] * len(regular[every - 1 :: max(every, 4)])
        for _ in range(len(loose) // every):
            k = rng.randrange(len(loose))
            loose[k : k + 1] = rng.choice([[], ["x%d" % k], [loose[k], "x%d" % k]])
        for k, copy in enumerate((regular, loose)):
            docs.append((2 * i + k, " ".join([*rng.choices(vocabulary, k=90), *copy, *rng.choices(vocabulary, k=90)])))
    # The surviving words of the first item stand in many texts, its lost ones in none.
    docs += [(100 + d, docs[0][1].replace("new", "y%d" % d)) for d in range(9)]
    want = {}
    for d, text in docs:
        for i, item in items:
            share = smith_waterman(item.split(), text.split()) / (2 * len(item.split()))
            shared = {tuple(item.split()[k : k + 3]) for k in range(len(item.split()) - 2)}
            if share >= 0.5 and shared & {tuple(text.split()[k : k + 3]) for k in range(len(text.split()) - 2)}:
                want[d, i] = share
    assert {(2 * i, i) for i, _ in items} | {(100 + d, 0) for d in range(9)} <= set(want)
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = decontamination.find_passages(table, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in got} == want


def test_long_excerpts_of_long_items_are_found(spark):
    rng = random.Random(14)
    vocabulary = ["w%d" % i for i in range(3000)]
    item, fill = rng.choices(vocabulary, k=300), lambda: rng.choices(vocabulary, k=80)
    edited = [x if k % 5 else "new" for k, x in enumerate(item[200:260])]
    parts = [item[80:220], item[:25], item[30:54], edited, item[100:130] + fill() + item[10:40], item]
    docs = [(d, " ".join([*fill(), *part, *fill()])) for d, part in enumerate(parts)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    got = {r["doc_id"]: r for r in decontamination.find_passages(table, bench).collect()}
    assert set(got) == {d for d, t in docs if smith_waterman(item, t.split()) >= 50} == {0, 1, 3, 4, 5}
    assert got[0]["score"] == 280 / 600 and docs[0][1].split()[got[0]["first_word"] : got[0]["end_word"]] == parts[0]
    assert {r["doc_id"] for r in decontamination.without_passages(table, bench).collect()} == {2}


def test_items_without_blanks_and_short_items_are_found(spark):
    items = [
        (1, "中国的首都是北京。它有三千年历史，人口超过两千万。"), (2, "日本で一番高い山は富士山です。"),
        (3, "กรุงเทพมหานครเป็นเมืองหลวงของประเทศไทย"), (4, "plain “quoted” words — here"), (5, "Forty-two"), (6, "yes"), (7, "。"),
    ]
    docs = [
        (1, "前文。" + items[0][1] + "后文"), (2, "序文、" + items[1][1].replace("一番", "最も") + "終わり"), (3, "ไทย " + items[2][1]),
        (4, "so plain quoted, words here"), (5, "forty two!"), (6, "Yes."), (10, "yes it is forty two of them"),
        (11, "上海是中国最大的城市。"), (12, "ภาษาไทย"), (13, ""), (14, None),
    ]
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontamination.find_passages(table, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(i, i) for i in range(1, 7)}
    assert {r["doc_id"] for r in got if r["score"] == 1} == {1, 3, 4, 5, 6}
    assert {r["doc_id"] for r in decontamination.without_passages(table, bench).collect()} == {10, 11, 12, 13, 14}


def test_word_hashes_tell_words_apart():
    texts = ["Ab c\td", None, "", "é É x", "ab C D", "\x0b a b"]
    hashes, offsets = hashing.word_hashes(texts)
    words = [re.findall(rb"[^ \t\n\x0b\x0c\r]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (t or "").encode())) for t in texts]
    assert np.diff(offsets).tolist() == [len(w) for w in words]
    flat = [w for own in words for w in own]
    assert all((hashes[i] == hashes[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))


# --- pipeline


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    rng = random.Random(12)
    langs = {"xx": ["zug", "ber", "sch", "und", "tzen", "lich"], "yy": ["ola", "que", "ion", "los", "amo", "nada"]}

    def text(lang, n=80):
        return " ".join(rng.choice(langs[lang]) + rng.choice(["", "a", "e"]) + rng.choice(langs[lang]) for _ in range(n))

    rows = [(i, text(x), x, "s", 0) for i in range(90) for x in [("xx", "yy")[i % 2]]]
    item = text("xx", 25)
    rows += [(100, rows[0][1], "xx", "s", 0), (101, rows[1][1] + " ola", "yy", "s", 0), (102, text("xx") + " " + item + " zug", "xx", "s", 0)]
    rows += [(103, text("yy") + " password=abcdefgh1 ola", "yy", "s", 1), (104, None, None, None, None), (105, "1 2", None, "s", 3)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(left["language"]) == {*range(90), 100, 101, 102, 103}
    assert set(left["near_copies"]) == {*range(90), 102, 103}
    assert set(left["decontamination"]) == set(left["secrets"]) == {*range(90), 103}
    assert left["secrets"][103].endswith(" <assign> ola") and docs.where("doc_id = 103").first()["n_chars"] == len(left["secrets"][103])
    assert {i: t for i, t in left["secrets"].items() if i != 103} == {i: t for i, t in left["decontamination"].items() if i != 103}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(left["secrets"])
    whole = {}
    for r in sorted(packed, key=lambda r: r["start"]):
        whole[r["doc_id"]] = whole.get(r["doc_id"], b"") + r["ids"]
    encoder = packing._encoder(packing.vocabulary())
    assert whole == {i: encoder.encode(t) + b"\0\0\0\0" for i, t in left["secrets"].items()}


def test_query_digests_are_those_of_the_contract(spark):
    import os

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("test tables are not here")
    rows = packing.op4_packing(spark, sf).collect()
    first = next(r for r in rows if r["length"] == r["doc_tokens"])
    text = spark.read.parquet(f"{sf}/documents.parquet").where(F.col("doc_id") == first["doc_id"]).first()["text"]
    ids = packing._encoder(packing.vocabulary()).encode(text) + b"\0\0\0\0"
    assert first["ids_crc32"] == zlib.crc32(ids)
    probe = chat.op10_chat_format(spark, sf).where("conv_id = -7").first()
    said = "</s>[INST] ok [/INST]"
    assert probe["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert probe["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest() and probe["valid"]
