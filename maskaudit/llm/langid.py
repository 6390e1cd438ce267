"""Language identification: an interpolated Kneser-Ney character model per language, in sorted hash arrays."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskaudit.llm.columns import carried
from maskaudit.llm.hashing import mix

ORDER = 4
TRAIN_CHARS = 4_000_000  # characters of labelled texts per language, about, that a model is fitted on
CALIBRATION_CHARS = 1_000_000  # the same, of other texts, for the rejection thresholds
CHUNK = 1 << 19  # characters scored at once
SPREADS = 8.0  # standard deviations above a language's mean at which a text is rejected
LEAD = 16  # characters before a part of a long text that it is seen with
SPACE = 32
GRAMS = "lang string, gram bigint, n bigint"


@cache
def _letters() -> np.ndarray:
    """Return for each code point its lower-case letter, folded into 16 bits, or a space."""
    table = np.full(0x110000, SPACE, dtype=np.uint16)
    for point in range(0x110000):
        c = chr(point)
        if unicodedata.category(c)[0] == "L":
            low = ord(c.lower()[0])
            folded = (low & 0xFFFF) ^ (low >> 16)
            table[point] = folded if folded > SPACE else folded + 0x100
    return table


def _pieces(texts: list[str | None]):
    """Yield (code points, text of each run, (length, lead) of each run): texts in runs of at most CHUNK characters.

    A long text is several runs; each but the first begins with the LEAD characters before it, which only are the
    context of those after them.
    """
    held, owner, lead, size = [], [], [], 0

    def joined():
        return _joined(held), np.array(owner), (np.array([len(x) for x in held]), np.array(lead))

    for k, text in enumerate(texts):
        text = text or ""
        for at in range(0, len(text), CHUNK):
            before = min(at, LEAD)
            part = text[at - before : at + CHUNK]
            if size and size + len(part) > CHUNK:
                yield joined()
                held, owner, lead, size = [], [], [], 0
            held.append(part)
            owner.append(k)
            lead.append(before)
            size += len(part)
    if held:
        yield joined()


def _joined(parts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _grams(points: np.ndarray, runs: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Return (n-grams of ORDER letters as 64-bit values, run of each), one per letter or first space after letters.

    A run is seen as lower-case letters with single spaces between and before; the last letter of a gram is its lowest
    16 bits.
    """
    lengths, lead = runs
    letters = _letters()[points].astype(np.uint64)
    run = np.repeat(np.arange(len(lengths)), lengths)
    keep = np.ones(len(letters), dtype=bool)
    start = np.concatenate(([True], run[1:] != run[:-1])) if len(run) else keep
    keep[1:] = (letters[1:] != SPACE) | (letters[:-1] != SPACE)
    keep &= ~(start & (letters == SPACE))
    counted = keep
    if lead.any():
        begin = np.cumsum(lengths) - lengths
        counted = keep & (np.arange(len(letters)) - begin[run] >= lead[run])
    counted = counted[keep]
    letters, run = letters[keep], run[keep]
    gram = letters.copy()
    for back in range(1, ORDER):
        before = np.full(len(letters), SPACE, dtype=np.uint64)
        before[back:] = np.where(run[back:] == run[:-back], letters[:-back], np.uint64(SPACE))
        gram |= before << np.uint64(16 * back)
    return gram[counted], run[counted]


def count_grams(docs: DataFrame) -> DataFrame:
    """Return (lang, gram, n) of the texts of ``docs`` (lang, text), summed over all rows."""

    def run(batches):
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), np.array(batch.column("lang").to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                own = [t for t, x in zip(texts, langs) if x == lang]
                for points, _, runs in _pieces(own):
                    gram, n = np.unique(_grams(points, runs)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n)],
                        ["lang", "gram", "n"],
                    )

    return docs.select("lang", "text").mapInArrow(run, GRAMS).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Log probabilities by order, all languages side by side, under sorted hashes of the n-grams.

    ``keys[o]`` are the sorted hashes of the (o + 1)-grams, ``logs[o]`` their log probabilities (rows) by language
    (columns), ``contexts[o]`` and ``backoffs[o]`` the same for what a context of o + 1 letters leaves to shorter
    ones; ``floor`` is the log probability of an unknown letter. ``limits`` are rejection thresholds by language.
    """

    langs: list[str]
    keys: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    backoffs: list[np.ndarray]
    floor: np.ndarray
    limits: np.ndarray | None = None

    def _find(self, table: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """Return the place of each gram's hash in a sorted table, or -1."""
        if len(table) == 0:
            return np.full(len(grams), -1)
        wanted = mix(grams)
        at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
        return np.where(table[at] == wanted, at, -1)

    def log_probability(self, grams: np.ndarray) -> np.ndarray:
        """Return the log probability of each gram's last letter after the others, by language."""
        out = np.zeros((len(grams), len(self.langs)), dtype=np.float32)
        left = np.arange(len(grams))
        for order in range(ORDER, 0, -1):
            tail = grams[left] & np.uint64((1 << (16 * order)) - 1) if order < 4 else grams[left]
            at = self._find(self.keys[order - 1], tail)
            hit = at >= 0
            out[left[hit]] += self.logs[order - 1][at[hit]]
            left, tail = left[~hit], tail[~hit]
            if order > 1 and len(left):
                context = self._find(self.contexts[order - 2], tail >> np.uint64(16))
                known = context >= 0
                out[left[known]] += self.backoffs[order - 2][context[known]]
        out[left] += self.floor
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Return (letters scored, mean negative log2 probability per letter by language) of each text."""
        total, count = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), dtype=np.int64)
        for points, owner, runs in _pieces(texts):
            gram, run = _grams(points, runs)
            if len(gram) == 0:
                continue
            kinds, place = np.unique(gram, return_inverse=True) if len(gram) < 4096 else _unique(gram)
            logs = self.log_probability(kinds)
            begins = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
            sums = np.add.reduceat(logs[place].astype(np.float64), begins, axis=0)
            np.add.at(total, owner[run[begins]], sums)
            np.add.at(count, owner[run[begins]], np.diff(np.concatenate((begins, [len(run)]))))
        return count, -total / np.log(2) / np.maximum(count, 1)[:, None]

    def judge(self, texts: list[str | None]) -> tuple[np.ndarray, ...]:
        """Return (letters, language, entropy, score, rejected) of each text, as ``identify`` describes them."""
        letters, entropy = self.entropies(texts)
        if not self.langs or not texts:
            zero = np.zeros(len(texts))
            return letters, np.full(len(texts), "und", dtype=object), zero, zero, np.ones(len(texts), dtype=bool)
        best = entropy.argmin(axis=1)
        least = entropy[np.arange(len(best)), best]
        # The posterior of the best language for ten letters of such a text.
        score = 1.0 / np.exp(np.clip((least[:, None] - entropy) * 10 * np.log(2), -60, 0)).sum(axis=1)
        limits = self.limits if self.limits is not None else np.full(len(self.langs), np.inf)
        rejected = least > limits[best] + 20.0 / np.sqrt(np.maximum(letters, 1))
        empty = letters == 0
        names = np.array([*self.langs, "und"], dtype=object)
        pred = names[np.where(empty, len(self.langs), best)]
        return letters, pred, np.where(empty, 0.0, least), np.where(empty, 0.0, score), empty | rejected


def _unique(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Return (distinct grams, place of each among them); hash slots find most without sorting all grams."""
    slots = (mix(grams) >> np.uint64(64 - 18)).astype(np.int64)
    holder = np.empty(1 << 18, dtype=np.int64)
    holder[slots] = np.arange(len(grams))
    first = holder[slots]
    same = grams[first] == grams
    heads = np.unique(first[same])
    rank = np.zeros(len(grams), dtype=np.int64)
    rank[heads] = np.arange(len(heads))
    place = rank[first]
    kinds = grams[heads]
    if not same.all():
        more, inverse = np.unique(grams[~same], return_inverse=True)
        place[~same] = inverse + len(kinds)
        kinds = np.concatenate((kinds, more))
    return kinds, place


def kneser_ney(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Fit a model per language on {lang: (grams of ORDER letters, counts)}."""
    langs = sorted(counts)
    tables = [np.unique(np.concatenate([counts[x][0] for x in langs])) if langs else np.zeros(0, np.uint64)]
    for order in range(ORDER - 1, 0, -1):
        tables.insert(0, np.unique(tables[0] & np.uint64((1 << (16 * order)) - 1)))
    logs = [np.zeros((len(t), len(langs))) for t in tables]
    contexts = [np.unique(t >> np.uint64(16)) for t in tables[1:]]
    backoffs = [np.zeros((len(c), len(langs))) for c in contexts]
    letters = len(tables[0]) + 1
    floor = np.zeros(len(langs))
    for x, lang in enumerate(langs):
        grams, n = counts[lang]
        n = n.astype(np.float64)
        levels = [(grams, n)]  # raw counts at the top, below it in how many contexts a gram was seen
        for order in range(ORDER - 1, 0, -1):
            tail, seen = np.unique(levels[0][0] & np.uint64((1 << (16 * order)) - 1), return_counts=True)
            levels.insert(0, (tail, seen.astype(np.float64)))
        below = None
        for order in range(1, ORDER + 1):
            grams, n = levels[order - 1]
            one, two = (n == 1).sum(), (n == 2).sum()
            discount = one / (one + 2.0 * two) if one and two else 0.5
            mine = np.zeros(len(tables[order - 1]))
            mine[np.searchsorted(tables[order - 1], grams)] = n
            held = np.maximum(mine - discount, 0.0)
            if order == 1:
                total = n.sum()
                left = discount * (mine > 0).sum() / total if total else 1.0
                probability = (held / total if total else held) + left / letters
                floor[x] = np.log(left / letters)
            else:
                table, context = tables[order - 1], contexts[order - 2]
                at = np.searchsorted(context, table >> np.uint64(16))
                total = np.bincount(at, mine, len(context))
                kinds = np.bincount(at, mine > 0, len(context))
                left = np.where(total > 0, discount * kinds / np.maximum(total, 1.0), 1.0)
                lower = below[np.searchsorted(tables[order - 2], table & np.uint64((1 << (16 * (order - 1))) - 1))]
                probability = held / np.maximum(total, 1.0)[at] + left[at] * lower
                backoffs[order - 2][:, x] = np.log(left)
            logs[order - 1][:, x] = np.log(probability)
            below = probability

    def by_hash(grams, rows):
        hashed = mix(grams)
        order = np.argsort(hashed)
        return hashed[order], rows[order].astype(np.float32)

    keyed = [by_hash(t, rows) for t, rows in zip(tables, logs)]
    behind = [by_hash(c, rows) for c, rows in zip(contexts, backoffs)]
    return Model(
        langs, [k for k, _ in keyed], [r for _, r in keyed], [k for k, _ in behind], [r for _, r in behind],
        floor.astype(np.float32),
    )


def _bounded(docs: DataFrame, chars: int, purpose: str) -> DataFrame:
    """Keep whole texts until each language has about ``chars`` characters: all below that, else a share by hash.

    One row per language, with its number of characters, comes to the driver.
    """
    totals = docs.groupBy("lang").agg(F.sum(F.length("text")).alias("n")).collect()
    # 62 bits of a hash against an integer, so that the share has no floor: however large the corpus, the sample is not empty.
    draw = F.pmod(F.xxhash64(F.lit(purpose), "text"), F.lit(1 << 62))
    keep = F.lit(False)
    for r in totals:
        keep = keep | ((F.col("lang") == r["lang"]) & (draw < F.lit((1 << 62) * chars // max(int(r["n"] or 0), chars))))
    return docs.where(keep)


def fit(
    labelled: DataFrame, calibration: DataFrame, train_chars: int = TRAIN_CHARS,
    calibration_chars: int = CALIBRATION_CHARS,
) -> Model:
    """Fit on ``labelled`` (lang, text) and set rejection thresholds on ``calibration``, texts that it did not see.

    The classifier is fitted on a bounded sample: whole texts, about ``train_chars`` characters per language, chosen
    by a hash of the text; so the number of n-grams that come to the driver is bounded too, by the product with the
    number of languages. A language's threshold is the mean cross-entropy of its calibration texts plus SPREADS
    standard deviations (and a part for short texts, see ``identify``). NULL texts and languages teach nothing.
    """
    def usable(df: DataFrame) -> DataFrame:
        return df.select("lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull())

    counts: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    found = count_grams(_bounded(usable(labelled), train_chars, "fit")).toArrow()
    langs = np.array(found.column("lang").to_pylist(), dtype=object)
    grams, n = found.column("gram").to_numpy().astype(np.uint64), found.column("n").to_numpy()
    for lang in sorted(set(langs)):
        counts[lang] = (grams[langs == lang], n[langs == lang])
    model = kneser_ney(counts)
    if not model.langs:
        return model
    scored = _score(_bounded(usable(calibration), calibration_chars, "calibrate"), model, ["lang"])
    stats = {
        r["lang"]: r
        for r in scored.where((F.col("lang") == F.col("lang_pred")) & (F.col("letters") >= 50)).groupBy("lang").agg(
            F.avg("entropy").alias("mean"), F.stddev_pop("entropy").alias("spread")
        ).collect()
    }
    none = {"mean": float("inf"), "spread": 0.0}
    model.limits = np.array(
        [stats.get(x, none)["mean"] + SPREADS * max(stats.get(x, none)["spread"], 0.02) for x in model.langs]
    )
    return model


SCORED = "letters bigint, lang_pred string, entropy double, score double, rejected boolean"


def _score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(model)
    fields = [docs.schema[c] for c in keep]

    def run(batches):
        model = held.value
        for batch in batches:
            letters, pred, least, score, rejected = model.judge(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in fields), pa.array(letters), pa.array(pred, pa.string()),
                 pa.array(least), pa.array(score), pa.array(rejected)],
                [*(f.name for f in fields), "letters", "lang_pred", "entropy", "score", "rejected"],
            )

    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
    columns = dict.fromkeys([*keep, "text"])
    return docs.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, ", ".join([*names, SCORED]))


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Predict the language of every whole text of ``docs`` (text).

    Adds to ``keep`` (default: all columns but ``text``): ``letters`` (with single spaces between words),
    ``lang_pred`` (least cross-entropy per letter, ties by name; ``und`` for NULL and texts without a letter),
    ``entropy`` (bits per letter), ``score`` (0 to 1) and ``rejected`` (``und``, or an entropy above the language's
    threshold plus 20 over the root of the letters, as short texts vary more). Languages of other columns are not
    looked at; repeated rows are kept; an empty table gives no row; see ``carried`` for names that clash.
    """
    return _score(docs, model, carried(docs, tuple(c.split()[0] for c in SCORED.split(", ")), keep))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """Return the rows of ``docs`` that ``identify`` does not reject, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(~held.value.judge(batch.column("text").to_pylist())[4]))

    return docs.mapInArrow(run, docs.schema)


def fold(doc_id: Column) -> Column:
    """Return crc32(doc_id as text) mod 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def fit_on_documents(docs: DataFrame) -> Model:
    """Fit on documents of fold 0 and calibrate on those of fold 2."""
    return fit(docs.where(fold(F.col("doc_id")) == 0), docs.where(fold(F.col("doc_id")) == 2))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from two folds of three."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = identify(docs, fit_on_documents(docs), ["doc_id"])
    return found.select(
        "doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", "score", "entropy", "letters", "rejected"
    )
