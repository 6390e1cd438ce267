"""Benchmark decontamination: n-gram seeds join texts to test items, Smith-Waterman alignments score them."""

from __future__ import annotations

import re
import sys
import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskaudit.llm import hashing as H
from maskaudit.llm.columns import carried

NGRAM = 3
SCORE = 0.5  # of the score of an exact copy
LEAST = 6  # words; an alignment scores at least as much as so many in a row, and shorter items count as a whole only
EXCERPT = 25  # words; an alignment that scores as much as so many in a row counts too, however long the item
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_CHARS = 32_000_000  # characters of test items that are looked for in one pass
TOGETHER = 512  # alignments computed side by side
MANY = 64  # places of items in one text from which on their words are counted first
COUNTED = 1 << 22  # words times items counted together
CELLS = 1 << 20  # of one row of all alignments computed side by side


#: Scripts without blanks between words: Thai to Tibetan, Myanmar, Khmer, kana, bopomofo, Han. Their characters are words.
SINGLES = (
    "\u0e01-\u0e4e\u0e50-\u0e59\u0e80-\u0eff\u0f00\u0f20-\u0f33\u0f40-\u0fbc\u1000-\u1049\u1050-\u109f\u1780-\u17d3"
    "\u3005-\u3007\u3041-\u3096\u30a1-\u30fa\u30fc-\u30ff\u3105-\u312f\u31a0-\u31bf\u31f0-\u31ff\u3400-\u9fff"
    "\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b16f\U00020000-\U0003ffff"
)


@cache
def _apart() -> tuple[frozenset[str], re.Pattern]:
    """Return the punctuation and blanks beyond ASCII, and a pattern of characters that are words."""
    marks = (chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c))[0] in "PZ")
    return frozenset([*marks, "\x85"]), re.compile(f"[{SINGLES}]")


def _spaced(text: str | None) -> str | None:
    """Put blanks for marks beyond ASCII and around characters that are words; most texts hold few kinds of either."""
    if not text or text.isascii():
        return text
    marks, singles = _apart()
    odd = {c for c in set(text) if c > "\x7f"}
    for mark in odd & marks:
        text = text.replace(mark, " ")
    return singles.sub(r" \g<0> ", text) if singles.search("".join(odd)) else text


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Return (hashes of all words, offsets of each text's): runs between marks and blanks, or characters of SINGLES."""
    return H.word_hashes([_spaced(t) for t in texts], H.MARKS)


@dataclass
class Items:
    """A block of test items: word hashes, and the seeds with the places where items have them."""

    ids: np.ndarray
    words: list[np.ndarray]
    grams: np.ndarray  # distinct, sorted
    begins: np.ndarray  # of each gram's rows in item and at
    item: np.ndarray
    at: np.ndarray
    vocabulary: np.ndarray  # distinct words of all items, sorted
    numbers: np.ndarray  # the items' words as places in the vocabulary, one item after the other
    first: np.ndarray  # of each item's numbers


def _indexed(ids, words, grams, item, at) -> Items:
    order = np.lexsort((at, item, grams))
    kinds, begins = np.unique(grams[order], return_index=True)
    vocabulary, numbers = np.unique(np.concatenate([*words, np.zeros(0, dtype=np.uint64)]), return_inverse=True)
    first = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
    return Items(ids, words, kinds, np.append(begins, len(grams)), item[order], at[order], vocabulary, numbers, first)


def index_items(ids: list, texts: list[str | None], n: int = NGRAM) -> Items:
    hashes, offsets = word_hashes(texts)
    grams, begins = H.shingles(hashes, offsets, n)
    item = np.repeat(np.arange(len(ids)), np.diff(begins))
    at = np.arange(len(grams)) - begins[:-1][item]
    words = [hashes[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
    return _indexed(np.array(ids, dtype=np.int64), words, grams, item, at)


def _hits(texts: list[str | None], items: Items, n: int):
    """Yield (first text, words, offsets, text of each hit, word of each hit, gram of each hit)."""
    for i, j in H.batches(texts):
        words, offsets = word_hashes(texts[i:j])
        grams, begins = H.shingles(words, offsets, n)
        if len(items.grams) == 0 or len(grams) == 0:
            continue
        # Most n-grams are no item's: a table of one bit per slot sends few on to the search.
        slots = np.zeros(1 << 20, dtype=bool)
        slots[(items.grams >> np.uint64(44)).astype(np.int64)] = True
        maybe = np.flatnonzero(slots[(grams >> np.uint64(44)).astype(np.int64)])
        place = np.minimum(np.searchsorted(items.grams, grams[maybe]), len(items.grams) - 1)
        found = items.grams[place] == grams[maybe]
        at, gram = maybe[found], place[found]
        text = np.searchsorted(begins, at, side="right") - 1
        yield i, words, offsets, text, at - begins[text], gram


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Return (best local alignment score, begin, end in the window) of each item and window of word hashes.

    Smith-Waterman with linear gaps. All pairs advance together, one item word at a time; within such a row, gaps in
    the item are a running maximum.
    """
    count, width = len(items), max(map(len, windows), default=0)
    best, end = np.zeros(count, dtype=np.int32), np.zeros(count, dtype=np.int64)
    begin = np.zeros(count, dtype=np.int64)
    if not width:
        return best, begin, end
    text = np.zeros((count, width), dtype=np.uint64)
    inside = np.zeros((count, width), dtype=bool)
    for k, w in enumerate(windows):
        text[k, : len(w)], inside[k, : len(w)] = w, True
    step = np.arange(width + 1, dtype=np.int64) * -GAP
    # Scores carry the place where their alignment began in the lowest bits, which also settles ties.
    bits = int(width + 1).bit_length()
    one = 1 << bits
    places = (width - np.arange(width + 1, dtype=np.int64))[None, :]
    score = np.broadcast_to(places, (count, width + 1)).copy()
    for i in range(max(map(len, items))):
        live = np.array([len(x) > i for x in items])
        word = np.array([x[i] if len(x) > i else 0 for x in items], dtype=np.uint64)
        same = (text == word[:, None]) & inside & live[:, None]
        change = np.where(same, MATCH, MISMATCH) * one
        fresh = np.broadcast_to(places, score.shape).copy()
        np.maximum(fresh[:, 1:], score[:, :-1] + change, out=fresh[:, 1:])
        np.maximum(fresh, score + GAP * one, out=fresh)
        fresh = np.maximum.accumulate(fresh + step * one, axis=1) - step * one
        low = fresh < one  # an empty alignment begins where it stands
        score = np.where(live[:, None], np.where(low, places, fresh), score)
        top = score.argmax(axis=1)
        value = score[np.arange(count), top]
        better = (value >> bits) > best
        best[better], end[better] = (value >> bits)[better], top[better]
        begin[better] = width - (value & (one - 1))[better]
    return best, begin, end


def _most(words: np.ndarray, window: np.ndarray) -> int:
    """Return a bound no alignment's score exceeds: of all runs of the window, the best if all words of the item match."""
    total = np.concatenate(([0], np.cumsum(np.where(np.isin(window, words), MATCH, max(MISMATCH, GAP)))))
    return int((total - np.minimum.accumulate(total)).max())


def _need(size: np.ndarray, score: float) -> np.ndarray:
    """Return the scores that alignments with items of ``size`` words need."""
    return MATCH * np.minimum(np.maximum(score * size, np.minimum(size, LEAST)), EXCERPT)


def _promising(words: np.ndarray, items: Items, item: np.ndarray, start: np.ndarray, score: float) -> np.ndarray:
    """Tell which places of a text (item, and where it would start) can hold an alignment, by counting words.

    A phrase that many items share gives a place of each of them wherever a text has it. No alignment scores more than
    MATCH for every word of its window that the item has; these are counted for all places at once, as differences of
    running counts, and few places go on to a closer look.
    """
    size = np.diff(items.first)[item]
    need = _need(size, score)
    slack = np.maximum((MATCH * size - need).astype(np.int64), 0)
    low, high = np.maximum(start - slack, 0), np.minimum(start + size + 2 * slack, len(words))
    number = np.minimum(np.searchsorted(items.vocabulary, words), len(items.vocabulary) - 1)
    known = items.vocabulary[number] == words
    kinds, place = np.unique(number[known], return_inverse=True)
    column = np.full(len(items.vocabulary), -1)
    column[kinds] = np.arange(len(kinds))
    out = np.zeros(len(item), dtype=bool)
    wanted, row = np.unique(item, return_inverse=True)
    step = max(1, COUNTED // (len(words) + 1))
    for begin in range(0, len(wanted), step):
        some = wanted[begin : begin + step]
        sizes = np.diff(items.first)[some]
        owner = np.repeat(np.arange(len(some)), sizes)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = column[items.numbers[items.first[some][owner] + inner]]
        has = np.zeros((len(some), len(kinds)), dtype=bool)
        has[owner[at >= 0], at[at >= 0]] = True
        count = np.zeros((len(some), len(words) + 1), dtype=np.int32)
        count[:, 1:][:, known] = has[:, place]
        np.cumsum(count, axis=1, out=count)
        mine = np.flatnonzero((row >= begin) & (row < begin + step))
        r = row[mine] - begin
        out[mine] = MATCH * (count[r, high[mine]] - count[r, low[mine]]) >= need[mine]
    return out


def _aligned(texts: list[str | None], items: Items, n: int, score: float):
    """Return (text, item, score, first word, end word) of the best alignment, if it suffices, of each text and item."""
    rows: dict[tuple[int, int], tuple[float, int, int]] = {}
    waiting: list[tuple[int, int, int, np.ndarray]] = []
    width = 0
    sizes = np.diff(items.first)
    needs, sizes = _need(sizes, score).tolist(), sizes.tolist()

    def flush():
        value, begin, end = align([items.words[x[1]] for x in waiting], [x[3] for x in waiting])
        for (text, item, base, _), v, a, b in zip(waiting, value, begin, end):
            if v >= needs[item]:
                share = float(v) / (MATCH * sizes[item])
                new = (share, -(base + int(a)), -(base + int(b)))
                rows[text, item] = max(rows.get((text, item), new), new)
        waiting.clear()

    for first, words, offsets, text, at, gram in _hits(texts, items, n):
        number = np.diff(items.begins)[gram]
        row = np.repeat(np.arange(len(gram)), number)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
        source = items.begins[gram][row] + inner
        item, start = items.item[source], at[row] - items.at[source]
        owner = text[row]
        many = np.bincount(owner) > MANY
        if many.any():
            kept = ~many[owner]
            for t in np.flatnonzero(many):
                mine = np.flatnonzero(owner == t)
                kept[mine] = _promising(words[offsets[t] : offsets[t + 1]], items, item[mine], start[mine], score)
            owner, item, start = owner[kept], item[kept], start[kept]
        order = np.lexsort((start, item, owner))
        last = None
        for t, i, s in zip(owner[order].tolist(), item[order].tolist(), start[order].tolist()):
            size, need = sizes[i], needs[i]
            slack = max(int(MATCH * size - need), 0)  # gaps, more of which leave less than the score
            if last and last[:2] == (t, i) and s <= last[2] + slack:
                continue  # the window of the seed before reaches this alignment as well
            last = (t, i, s)
            a, b = max(0, s - slack), min(offsets[t + 1] - offsets[t], s + size + 2 * slack)
            window = words[offsets[t] + a : offsets[t] + b]
            if _most(items.words[i], window) < need:
                continue
            width = max(width, len(window)) if waiting else len(window)
            waiting.append((first + t, i, a, window))
            if len(waiting) >= TOGETHER or len(waiting) * width >= CELLS:
                flush()
    if waiting:
        flush()
    return [(t, i, share, -a, -b) for (t, i), (share, a, b) in sorted(rows.items())]


def _blocks(docs: DataFrame, benchmark: DataFrame, n: int):
    """Yield a broadcast of seeds and items per block of ``benchmark``; each block is bounded by BLOCK_CHARS."""
    spark = docs.sparkSession
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct()
    size = items.agg(F.sum(F.length("text"))).collect()[0][0] or 0
    blocks = int(size) // BLOCK_CHARS + 1
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        yield spark.sparkContext.broadcast(index_items([r["item_id"] for r in rows], [r["text"] for r in rows], n))


FOUND = "item_id bigint, score double, first_word bigint, end_word bigint"


def find_passages(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, score: float = SCORE) -> DataFrame:
    """Find exact, edited and paraphrased copies of benchmark items (item_id, text) in the texts of ``docs``.

    An alignment counts from ``score`` of an exact copy's on, but not below that of LEAST words in a row, or with that of
    EXCERPT words in a row: an item of up to LEAST words has to stand there as a whole, so a common phrase of it is no
    copy, and long excerpts of any item are found. Returns a row per such text and item: the columns of ``docs`` other than ``text``, ``item_id``,
    ``score`` (of the best alignment, 1 for an exact copy) and its words ``first_word`` to ``end_word`` (exclusive;
    words are runs other than marks and blanks, and single characters in scripts without blanks, see ``word_hashes``).

    One pass over the texts, without a shuffle of them: every n-gram of an item is a seed, and the words around it are
    aligned unless too few of them are the item's. A copy that shares no ``n`` words in a row with the item has no
    seed. Items of fewer than ``n`` words are found where they are all words of a text. Items come in blocks of
    bounded size, a pass per block. NULL items and those without words are not looked for;
    NULL texts are empty; repeated rows are kept; an empty table gives no row; see ``carried`` for names that clash.
    """
    others = [docs.schema[c] for c in carried(docs, tuple(c.split()[0] for c in FOUND.split(", ")))]
    out = docs.sparkSession.createDataFrame([], ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), FOUND]))
    for held in _blocks(docs, benchmark, n):

        def run(batches, held=held):
            items = held.value
            for batch in batches:
                found = _aligned(batch.column("text").to_pylist(), items, n, score)
                if found:
                    text, item, share, first, end = zip(*found)
                    at = pa.array(text)
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(f.name).take(at) for f in others), pa.array(items.ids[list(item)]),
                         pa.array(share), pa.array(first, pa.int64()), pa.array(end, pa.int64())],
                        [*(f.name for f in others), "item_id", "score", "first_word", "end_word"],
                    )

        out = out.unionByName(docs.select(*[F.col(f"`{f.name}`") for f in others], "text").mapInArrow(run, out.schema))
    return out


def without_passages(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, score: float = SCORE) -> DataFrame:
    """Return the rows of ``docs`` in whose text ``find_passages`` finds nothing."""
    schema, kept = docs.schema, docs
    for held in _blocks(docs, benchmark, n):

        def run(batches, held=held):
            for batch in batches:
                found = {x[0] for x in _aligned(batch.column("text").to_pylist(), held.value, n, score)}
                yield batch.filter(pa.array([k not in found for k in range(batch.num_rows)], pa.bool_()))

        kept = kept.mapInArrow(run, schema)
    return kept


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or an edited copy of one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "score", "first_word", "end_word")
