"""Places of pattern matches as DataFrame expressions: starts and ends in code points."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:bigint,end:bigint,value:string>>"


@dataclass(frozen=True)
class Rule:
    """A kind of span: a Java pattern, a cheap test that a text with a match passes, and a check of each match.

    Matches go leftmost and non-overlapping. One that fails ``keep`` is dropped; nothing inside it is tried again.
    """

    kind: str
    pattern: str
    probe: Callable[[Column], Column]
    keep: Callable[[Column], Column] | None = None
    version: int = 1


def has(*words: str) -> Callable[[Column], Column]:
    """Return a test that a text holds one of ``words``."""

    def probe(text: Column) -> Column:
        found = F.lit(False)
        for word in words:
            found = found | F.contains(text, F.lit(word))
        return found

    return probe


def like(pattern: str) -> Callable[[Column], Column]:
    return lambda text: F.rlike(text, F.lit(pattern))


def _fold(parts: Column, start: Column) -> Column:
    """Return the spans of ``parts`` (gap, size, value), the first gap beginning at ``start``."""
    empty = F.array().cast(SPAN)
    step = F.aggregate(
        parts,
        F.struct(start.alias("at"), empty.alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["size"]).alias("at"),
            F.concat(
                acc["out"],
                F.array(
                    F.struct(
                        (acc["at"] + x["gap"]).alias("start"),
                        (acc["at"] + x["gap"] + x["size"]).alias("end"),
                        x["value"].alias("value"),
                    )
                ),
            ).alias("out"),
        ),
    )
    return step["out"]


GROUP = 64


def starts_of(parts: Column) -> Column:
    """Turn (gap before, size, value) of consecutive matches into spans.

    Sums run over groups of 64 and then over the groups, as growing one array match by match copies it every time.
    """
    groups = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / GROUP).cast("int")),
        lambda g: F.slice(parts, g * GROUP + 1, F.lit(GROUP)),
    )
    sums = F.transform(groups, lambda g: F.aggregate(g, F.lit(0).cast("bigint"), lambda a, x: a + x["gap"] + x["size"]))
    offsets = F.aggregate(
        sums,
        F.array(F.lit(0).cast("bigint")),
        lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + s)),
    )
    spans = F.flatten(
        F.zip_with(groups, F.slice(offsets, F.lit(1), F.size(groups)), lambda g, at: _fold(g, at))
    )
    return F.when(F.size(parts) > 0, spans).otherwise(F.array().cast(SPAN))


def find(text: Column, rule: Rule) -> Column:
    """Return the kept spans of ``rule`` in ``text`` (not NULL)."""
    pattern = F.lit(rule.pattern)
    parts = F.zip_with(
        F.split(text, rule.pattern, -1),
        F.regexp_extract_all(text, pattern, F.lit(0)),
        lambda gap, match: F.struct(
            F.length(gap).cast("bigint").alias("gap"), F.length(match).cast("bigint").alias("size"), match.alias("value")
        ),
    )
    spans = starts_of(F.filter(parts, lambda x: x["value"].isNotNull()))
    if rule.keep is not None:
        spans = F.filter(spans, lambda s: rule.keep(s["value"]))
    return F.when(rule.probe(text), spans).otherwise(F.array().cast(SPAN))


def listing(spans: dict[str, Column]) -> Column:
    """Return ``kind:start:end`` of all spans by start, then by the order of the kinds, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in spans])

    def ranked(rank: int, column: Column) -> Column:
        return F.transform(
            column, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("kind"), s["end"].alias("end"))
        )

    rows = F.concat(*[ranked(n, column) for n, column in enumerate(spans.values(), 1)])
    return F.array_join(
        F.transform(
            F.array_sort(rows),
            lambda r: F.concat_ws(
                ":", F.element_at(kinds, r["kind"]), r["start"].cast("string"), r["end"].cast("string")
            ),
        ),
        ",",
    )


def rewrite(text: Column, edits: Column) -> Column:
    """Replace the spans of ``edits`` (array of struct<start, end, mark>) in ``text`` by their marks.

    A span that begins inside one before it (by start, then end, then mark) goes without a mark of its own.
    """

    def piece(start: Column, end: Column) -> Column:
        return F.substring(text, (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))

    built = F.aggregate(
        F.array_sort(edits),
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, e: F.when(
            e["start"] >= acc["at"],
            F.struct(e["end"].alias("at"), F.concat(acc["out"], F.array(piece(acc["at"], e["start"]), e["mark"])).alias("out")),
        ).otherwise(F.struct(F.greatest(acc["at"], e["end"]).alias("at"), acc["out"].alias("out"))),
    )
    return F.concat(F.array_join(built["out"], ""), piece(built["at"], F.length(text).cast("bigint")))
