"""Packing: token sequences of one window, filled by best-fit decreasing over a segment tree of open windows."""

from __future__ import annotations

import base64
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskaudit.llm.columns import carried

WINDOW = 1024
END = 0  # id after each document
POOL = 1 << 22  # tokens that are packed together


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Return the path of a public tokenizer file as installed here."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts as little-endian 32-bit bytes.

    Both public libraries hold the same vocabulary. Texts of Latin-1 characters, on whose classes their releases agree,
    go to the faster one, and all others to ``tokenizers``. With ``added``, the vocabulary's added tokens in a text get
    their own ids, as ``tokenizers`` gives them by default: texts that hold one go there. Without, they are plain text.
    """

    def __init__(self, path: str, added: bool = False):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = not added
        self.fast = _ranked(path)
        tokens = self.slow.get_added_tokens_decoder().values() if added else ()
        if any(t.normalized or t.single_word for t in tokens):
            self.fast = None  # such a token may stand in a text in another form
        self.added = tuple(t.content for t in tokens)

    def encode(self, text: str) -> bytes:
        if self.fast is not None and _latin(text) and not any(t in text for t in self.added):
            return np.array(self.fast.encode_ordinary(text), dtype="<u4").tobytes()
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def _latin(text: str) -> bool:
    try:
        return bool(text.isascii() or text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


def _ranked(path: str):
    """Return a faster encoder of the same vocabulary, where its rank file stands beside the tokenizer's file."""
    import os

    ranks = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks):
        return None
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


@cache
def _encoder(path: str, added: bool = False) -> Encoder:
    return Encoder(path, added)


class OpenWindows:
    """Windows by remaining capacity, 1 to ``size``, under a segment tree that counts windows per range of capacity."""

    def __init__(self, size: int):
        self.size = size
        self.width = 1 << size.bit_length()
        self.tree = [0] * (2 * self.width)
        self.at: list[list[int]] = [[] for _ in range(self.width)]

    def _add(self, capacity: int, change: int) -> None:
        node = capacity + self.width
        while node:
            self.tree[node] += change
            node >>= 1

    def put(self, capacity: int, window: int) -> None:
        if capacity:
            self.at[capacity].append(window)
            self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Take the window with the least capacity >= need; return (capacity, window)."""
        node = need + self.width
        if not self.tree[node]:
            while node > 1 and (node & 1 or not self.tree[node + 1]):  # up until a right neighbour holds a window
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.width:
                node = 2 * node if self.tree[2 * node] else 2 * node + 1
        capacity = node - self.width
        self._add(capacity, -1)
        return capacity, self.at[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, int]:
    """Pack pieces of 1 to ``size`` tokens; return (window of each, offset of each, number of windows)."""
    windows, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    opened, count = OpenWindows(size), 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        found = opened.take(need)
        if found is None:
            found, count = (size, count), count + 1
        capacity, window = found
        windows[k], offsets[k] = window, size - capacity
        opened.put(capacity - need, window)
    return windows, offsets, count


PIECES = "start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


def pack(
    docs: DataFrame, path: str, size: int = WINDOW, end: int = END, pool: int = POOL, added: bool = False
) -> DataFrame:
    """Pack the texts of ``docs`` into sequences of at most ``size`` tokens.

    A document is the ids of its text (NULL: empty; ``added``: see Encoder) and then ``end``. A document longer than a window is cut into full
    windows and a rest; rests and shorter documents go, longest first, into the open window they fill best. Returns
    per piece the columns of ``docs`` other than ``text`` and

    - ``start`` (ids of its document before it), ``length``, ``doc_tokens``, ``ids`` (little-endian 32-bit),
    - ``sequence_id`` and ``offset`` (its first token's place there; pieces stand without gaps from 0).

    Each task packs its own documents in pools of about ``pool`` tokens, which bounds memory, needs no shuffle and
    leaves a part of a window open per pool; a sequence's id is the partition's number times 2**32 plus a running
    number. Repeated rows and NULL ids are packed as they come, an empty table gives no row; see ``carried`` for
    names that clash.
    """
    others = [docs.schema[c] for c in carried(docs, tuple(c.split()[0] for c in PIECES.split(", ")))]

    def run(batches):
        from pyspark import TaskContext

        encoder = _encoder(path, added)
        number = TaskContext.get().partitionId() << 32
        last = np.array([end], dtype="<u4").tobytes()
        held, rows, tokens = [], [], 0

        def flush():
            nonlocal number, held, rows, tokens
            row, start, length = [], [], []
            for k, ids in enumerate(held):
                n = len(ids) // 4
                at = range(0, n, size)
                row += [k] * len(at)
                start += at
                length += [min(size, n - a) for a in at]
            lengths = np.array(length, dtype=np.int64)
            window, offset, count = best_fit_decreasing(lengths, size)
            order = np.lexsort((offset, window))
            pieces = [held[row[k]][4 * start[k] : 4 * (start[k] + length[k])] for k in order]
            take = pa.array(np.array(row, dtype=np.int64)[order])
            total = np.array([len(x) // 4 for x in held], dtype=np.int64)
            columns = [c.take(take) for c in pa.Table.from_batches(rows).select([f.name for f in others]).columns]
            found = pa.table(
                [*columns, pa.array(np.array(start, dtype=np.int64)[order]), pa.array(lengths[order]),
                 pa.array(total[np.array(row, dtype=np.int64)[order]]), pa.array(window[order] + number),
                 pa.array(offset[order]), pa.array(pieces, pa.binary())],
                [*(f.name for f in others), "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )
            number += count
            held, rows, tokens = [], [], 0
            return found.combine_chunks().to_batches(max_chunksize=1 << 14)

        for batch in batches:
            texts, begin = batch.column("text").to_pylist(), 0
            for k, text in enumerate(texts):
                held.append((encoder.encode(text) if text else b"") + last)
                tokens += len(held[-1]) // 4
                if tokens >= pool:
                    rows.append(batch.slice(begin, k + 1 - begin))
                    begin = k + 1
                    yield from flush()
            if begin < len(texts):
                rows.append(batch.slice(begin).drop_columns(["text"]).append_column("text", pa.nulls(len(texts) - begin, pa.string())))
        if held:
            yield from flush()

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    return docs.select(*[F.col(f"`{f.name}`") for f in others], "text").mapInArrow(
        run, ", ".join(x for x in (names, PIECES) if x)
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 1,024 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, vocabulary(), added=True).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
