"""Best-fit packing by minimum bin slack: each sequence takes the fullest combination of the lengths that are left."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskaudit.llm.columns import carried
from maskaudit.llm.packing import END, Encoder, vocabulary

SIZE = 2048
POOL = 1 << 23  # tokens, and COST for each document, that are packed together
COST = 16


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(path, True)


def fullest(lengths: list[int], counts: list[int], room: int) -> tuple[int, list[tuple[int, int]]]:
    """Return (sum, [(length, times)]) of the fullest combination of available lengths that fits into ``room``.

    ``lengths`` are the different ones in ascending order, ``counts[n]`` how often length n is there. Bit s of a number
    says whether a sum s can be reached; a length is a shift of all sums, and k copies of it are shifts by 1, 2, 4 ... of
    them. Lengths come longest first and the search ends when ``room`` is reached, so of the combinations that fill it the
    one with the longest shortest piece is taken, and short pieces stay for later gaps.
    """
    reach, goal, mask = 1, 1 << room, (2 << room) - 1
    steps = []
    for at in range(bisect_right(lengths, room) - 1, -1, -1):
        if reach & goal:
            break
        n = lengths[at]
        copies, times = min(counts[n], room // n), 1
        while copies:
            times = min(times, copies)
            steps.append((reach, n, times))
            reach |= (reach << (n * times)) & mask
            copies -= times
            times *= 2
    total = rest = reach.bit_length() - 1
    chosen = []
    for before, n, times in reversed(steps):
        if not before >> rest & 1:
            chosen.append((n, times))
            rest -= n * times
    return total, chosen


def minimum_slack(sizes: np.ndarray, room: int = SIZE) -> tuple[np.ndarray, np.ndarray, int]:
    """Pack pieces of 1 to ``room`` tokens; return (bin of each, offset of each, number of bins).

    Each bin is the fullest combination of the pieces left, which are then removed; of equally full ones it is one with
    the longest piece that is left.
    """
    bins, offsets = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    values, first, number = np.unique(-sizes[order], return_index=True, return_counts=True)
    waiting = {int(-v): order[a : a + c][::-1].tolist() for v, a, c in zip(values, first, number)}
    lengths = sorted(waiting)
    counts = [0] * (room + 1)
    for n, at in waiting.items():
        counts[n] = len(at)
    count = 0

    def remove(n: int, times: int) -> None:
        counts[n] -= times
        if counts[n] == 0:
            del lengths[bisect_left(lengths, n)]

    while lengths:
        longest = lengths[-1]
        counts[longest] -= 1
        total, chosen = fullest(lengths, counts, room - longest)
        counts[longest] += 1
        total, chosen = total + longest, [(longest, 1), *chosen]
        if total < room:
            other = fullest(lengths, counts, room)
            total, chosen = max((total, chosen), other, key=lambda x: x[0])
        offset = 0
        for n, times in chosen:
            for _ in range(times):
                piece = waiting[n].pop()
                bins[piece], offsets[piece] = count, offset
                offset += n
            remove(n, times)
        count += 1
    return bins, offsets, count


def pieces_of(tokens: int, size: int) -> list[tuple[int, int]]:
    """Return (start, length) of a document's pieces: one, or the rest over whole pieces and then these."""
    rest = tokens % size if tokens > size else tokens
    cuts = [0] * (rest > 0) + list(range(rest, tokens, size))
    return list(zip(cuts, [b - a for a, b in zip(cuts, [*cuts[1:], tokens])]))


PIECES = "piece int, start bigint, length bigint, sequence_id bigint, offset bigint, ids binary"


def pack_tight(docs: DataFrame, path: str, size: int = SIZE, end: int = END, pool: int = POOL) -> DataFrame:
    """Pack the texts of ``docs`` into as few sequences of at most ``size`` tokens as minimum bin slack finds.

    A document is the ids of its text (NULL: empty), added tokens of the vocabulary with their own ids, and then ``end``.
    Only a document longer than a sequence is cut: into a rest that comes first and pieces of ``size`` tokens. Returns
    per piece the columns of ``docs`` other than ``text`` and

    - ``piece`` (its number in its document), ``start`` (ids before it), ``length``, ``ids`` (little-endian 32-bit),
    - ``sequence_id`` and ``offset`` (its first token's place there; pieces stand without gaps from 0).

    Each task packs its own documents in pools of about ``pool`` tokens: memory is bounded, nothing is shuffled, and a pool
    leaves a few sequences open at its end. A sequence's id is the partition's number times 2**32 plus a running number.
    Among pieces of one length the order of the table decides. Repeated rows and NULL ids are packed as they come,
    an empty table gives no row; see ``carried`` for names that clash.
    """
    made = tuple(c.split()[0] for c in PIECES.split(", "))
    others = [docs.schema[c] for c in carried(docs, made)]

    def flush(rows: list[pa.RecordBatch], held: list[bytes], number: int):
        cut = [pieces_of(len(ids) // 4, size) for ids in held]
        owner = np.repeat(np.arange(len(held)), [len(c) for c in cut])
        piece = np.concatenate([np.arange(len(c)) for c in cut])
        start, length = np.array([p for c in cut for p in c], dtype=np.int64).T
        bins, offset, count = minimum_slack(length, size)
        order = np.lexsort((offset, bins))
        table = pa.Table.from_batches(rows)
        for part in np.array_split(order, len(order) // 8192 + 1):
            ids = [held[o][4 * s : 4 * (s + n)] for o, s, n in zip(owner[part].tolist(), start[part].tolist(), length[part].tolist())]
            take = pa.array(owner[part])
            columns = [table.column(f.name).take(take).combine_chunks() for f in others]
            made_columns = [pa.array(piece[part], pa.int32()), *(pa.array(x[part]) for x in (start, length, bins + number, offset)), pa.array(ids, pa.binary())]
            yield count, pa.Table.from_arrays([*columns, *made_columns], [*(f.name for f in others), *made]).combine_chunks()

    def run(parts):
        from pyspark import TaskContext

        encoder = _encoder(path)
        last = np.array([end], dtype="<u4").tobytes()
        number, held, rows, filled = TaskContext.get().partitionId() << 32, [], [], 0

        def emptied():
            nonlocal number, held, rows, filled
            for count, table in flush(rows, held, number):
                yield from table.to_batches()
            number, held, rows, filled = number + count, [], [], 0

        for batch in parts:
            # Columns of this batch without the texts, which are not needed once they are ids.
            lean = batch.drop_columns(["text"]).append_column("_", pa.nulls(batch.num_rows, pa.bool_()))
            begin = 0
            for k, text in enumerate(batch.column("text").to_pylist()):
                held.append((encoder.encode(text) if text else b"") + last)
                filled += len(held[-1]) // 4 + COST
                if filled >= pool:
                    rows.append(lean.slice(begin, k + 1 - begin))
                    begin = k + 1
                    yield from emptied()
            if begin < batch.num_rows:
                rows.append(lean.slice(begin))
        if held:
            yield from emptied()

    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in others]
    return docs.select(*[F.col(f"`{f.name}`") for f in others], F.col("text").cast("string").alias("text")).mapInArrow(
        run, ", ".join([*names, PIECES])
    )


def op12_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2,048 tokens by minimum bin slack."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_tight(docs, vocabulary()).select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"
    )
