"""Token counts: greedy longest-match word pieces by one pass of an automaton, without building the pieces."""

from __future__ import annotations

import json
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskaudit.llm.columns import carried
from maskaudit.llm.packing import vocabulary

KEPT = 1 << 19  # words whose counts a task remembers
LONGEST = 64  # bytes of words that are remembered


def byte_letters() -> dict[str, int]:
    """Return the byte that each character of a byte-level vocabulary stands for.

    Visible Latin-1 characters stand for themselves and the other bytes, in order, for the characters from U+0100 on.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


def byte_pieces(path: str) -> list[bytes]:
    """Return the pieces of a byte-level vocabulary file as bytes; its special tokens are left out."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"] for t in model.get("added_tokens", ())}
    letters = byte_letters()
    return [bytes(letters[c] for c in piece) for piece in model["model"]["vocab"] if piece not in special]


class Automaton:
    """A trie of pieces with failure links that count the longest-match pieces popped on the way.

    Where the node of a string s has no child for the next byte, ``fail[node]`` is the node of what is left of s after
    its longest-match pieces are taken off until the rest is a prefix of a piece, and ``popped[node]`` how many pieces
    that takes. -1: no piece matches. The link of a node comes from its parent's, so both are built breadth first, and
    a string is counted in time linear in its length.
    """

    def __init__(self, pieces: list[bytes]):
        self.child: dict[int, int] = {}
        ends = [False]
        order: list[tuple[int, int, int]] = []
        for piece in pieces:
            node = 0
            for byte in piece:
                edge = node << 8 | byte
                to = self.child.get(edge)
                if to is None:
                    to = self.child[edge] = len(ends)
                    ends.append(False)
                    order.append((node, byte, to))
                node = to
            ends[node] = node > 0
        self.fail, self.popped = [-1] * len(ends), [0] * len(ends)
        depth = [0] * len(ends)
        for parent, _, to in order:
            depth[to] = depth[parent] + 1
        for parent, byte, to in sorted(order, key=lambda x: depth[x[2]]):
            if ends[to]:
                self.fail[to], self.popped[to] = 0, 1
                continue
            node, count = self.fail[parent], self.popped[parent]
            while node >= 0 and (node << 8 | byte) not in self.child:
                count += self.popped[node]
                node = self.fail[node]
            if node >= 0:
                self.fail[to], self.popped[to] = self.child[node << 8 | byte], count
        # At the end of a string the rest below each node is popped until the root is reached.
        self.close = [0] * len(ends)
        for _, _, to in sorted(order, key=lambda x: depth[x[2]]):
            back = self.fail[to]
            self.close[to] = -1 if back < 0 or self.close[back] < 0 else self.popped[to] + self.close[back]

    def count(self, word: bytes) -> int:
        """Return the number of greedy longest-match pieces of ``word``; 1 (unknown) where it cannot be cut."""
        child, fail, popped = self.child, self.fail, self.popped
        node = total = 0
        for byte in word:
            to = child.get(node << 8 | byte)
            while to is None:
                total += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
                to = child.get(node << 8 | byte)
                if to is None and node == 0:
                    return 1
            node = to
        return total + self.close[node] if self.close[node] >= 0 else 1


class WordCounts(dict):
    """Counts of words, remembered up to a number of them; a word's first piece starts with a space."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(b" " + word)
        if len(word) <= LONGEST:
            if len(self) >= KEPT:
                self.clear()
            self[word] = n
        return n


@cache
def _word_counts(path: str) -> WordCounts:
    return WordCounts(Automaton(byte_pieces(path)))


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """Add ``n_words`` and ``n_tokens`` (greedy longest-match pieces of all words) to the columns other than ``text``.

    Words are runs of bytes other than space and U+0009 to U+000D; each is matched with a space before it, as the
    vocabulary's word-initial pieces have it. NULL and empty texts have 0 words; repeated rows are kept; an empty
    table gives no row; see ``carried`` for names that clash.
    """
    others = [docs.schema[c] for c in carried(docs, ("n_words", "n_tokens"))]

    def run(batches):
        counts = _word_counts(path)
        for batch in batches:
            words, tokens = [], []
            for text in batch.column("text").to_pylist():
                found = text.encode("utf-8", "surrogatepass").split() if text else []
                words.append(len(found))
                tokens.append(sum(map(counts.__getitem__, found)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in others), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())],
                [*(f.name for f in others), "n_words", "n_tokens"],
            )

    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in others]
    return docs.select(*[F.col(f"`{f.name}`") for f in others], "text").mapInArrow(
        run, ", ".join([*names, "n_words bigint", "n_tokens bigint"])
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word and token counts of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, vocabulary())
