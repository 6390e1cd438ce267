"""License scans: exact containment of license templates in the blocks of every text."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskaudit.llm.columns import carried

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases whose words, in a row, name a license.
PHRASES = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}
# Notices as they stand in files; a label may have several.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and"
            " associated documentation files to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu"
              " general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided"
            " that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
CONTAINMENT = 0.9


@dataclass(frozen=True)
class Template:
    """One notice: its distinct words from the rarest to the most frequent, and how many of them a block must hold."""

    label: str
    words: tuple[str, ...]
    need: int
    length: int = 0  # words of the notice, repeated ones too

    @property
    def prefix(self) -> tuple[str, ...]:
        return self.words[: len(self.words) - self.need + 1]


def _strings(words) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def _folded(text: Column) -> Column:
    """Lower-case A-Z; other letters may change case too, but none becomes one of a-z (the Kelvin sign would)."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u00e9")))


def block_words(text: Column, block: str = "\n") -> Column:
    """Return the words of every block of a text, in order, as ``array<array<string>>``."""
    return F.transform(F.split(_folded(text), block, -1), lambda b: F.regexp_extract_all(b, F.lit(WORD), F.lit(0)))


def order_templates(
    docs: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT, block: str = "\n"
) -> list[Template]:
    """Order the words of all templates by the number of blocks of ``docs`` that hold them (ties by word).

    Counts run over every block of every text. What comes to the driver is one row per template word, a number fixed
    by the parameter ``templates``.
    """
    lists = [(label, re.findall(WORD, text.lower())) for label, text in templates]
    sets = [(label, sorted(set(words)), len(words)) for label, words in lists]
    vocabulary = _strings(sorted({w for _, words, _ in sets for w in words}))
    held = F.flatten(F.transform(block_words(F.col("text"), block), lambda b: F.array_intersect(vocabulary, b)))
    counts = docs.select(F.explode(held).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()
    seen = {r["word"]: r["n"] for r in counts}
    return [
        Template(
            label,
            tuple(sorted(words, key=lambda w: (seen.get(w, 0), w))),
            math.ceil(containment * len(words) - 1e-9),
            length,
        )
        for label, words, length in sets
        if words
    ]


def _global_order(templates: list[Template]) -> list[str]:
    """Merge the templates' orders, which agree with each other, into one list of words."""
    after: dict[str, set[str]] = {}
    for t in templates:
        for k, word in enumerate(t.words):
            after.setdefault(word, set()).update(t.words[:k])
    out: list[str] = []
    while len(out) < len(after):
        out.append(min(w for w, before in after.items() if w not in out and before <= set(out)))
    return out


def _matches(block: Column, template: Template) -> Column:
    """Return whether a block's template words (rarest first) hold enough of ``template``.

    Cheapest test first. Length: the block has as many words. Prefix: of the words in global order, the first ones of
    both sides share one. Position: the words from the first shared one on, on the shorter side, still suffice.
    """
    need, n = template.need, len(template.words)
    shared = F.array_intersect(F.slice(block, F.lit(1), F.size(block) - F.lit(need - 1)), _strings(template.prefix))
    first = F.get(shared, 0)
    left = F.least(
        F.lit(n) - F.array_position(_strings(template.words), first), F.size(block) - F.array_position(block, first)
    )
    return (
        F.when(F.size(block) < need, False)
        .when(F.size(shared) == 0, False)
        .when(left + 1 < need, False)
        .otherwise(F.size(F.array_intersect(block, _strings(template.words))) >= need)
    )


def find_licenses(
    docs: DataFrame, templates: list[Template], phrases: dict[str, str] = PHRASES, block: str = "\n",
    keep: list[str] | None = None,
) -> DataFrame:
    """Join every block of every text with the templates it contains to the threshold, and find phrases.

    Adds to ``keep`` (default: all columns but ``text``): ``n_words``; ``phrases``, an array of (label, first word) of
    all places where a phrase's words stand in a row; ``notices``, an array of (block from 0, label, share of the
    template's words that the block holds); ``wrapped``, an array of (first word, label, share) for notices that go over
    several blocks: runs of twice a template's words, begun every half of them, that hold enough of it and do so in no
    block they touch. Runs overlap, so one notice can stand in several. The template side is a parameter, so each row is joined where it lies and
    nothing is shuffled. NULL text counts as empty, repeated rows and NULL ids are kept, an empty table gives no row.
    """
    columns = carried(docs, ("n_words", "phrases", "notices", "wrapped"), keep)
    order = _strings(_global_order(templates))
    fewest = min((t.need for t in templates), default=1)
    probe = "|".join(GAP.join(p.split()) for p in phrases.values())
    base = docs.select(*columns, block_words(F.col("text"), block).alias("_words"), _folded(F.col("text")).alias("_low"))
    base = base.select(
        *columns,
        F.aggregate("_words", F.lit(0).cast("bigint"), lambda a, b: a + F.size(b)).alias("n_words"),
        F.transform("_words", lambda b: F.array_intersect(order, b)).alias("_blocks"),
        F.when(F.rlike("_low", F.lit(probe)), F.flatten("_words")).alias("_text"),
        F.when(F.size("_words") > 1, F.col("_words")).alias("_lines"),
    ).withColumn("_held", F.when(F.col("_lines").isNotNull(), F.array_distinct(F.flatten("_blocks"))))
    places = [_places(F.col("_text"), label, phrase.split()) for label, phrase in phrases.items()]
    numbered = F.filter(
        F.transform("_blocks", lambda b, n: F.struct(n.alias("block"), b.alias("words"))),
        lambda x: F.size(x["words"]) >= fewest,
    )
    found = [_notices(F.col("_long"), t) for t in templates]
    runs = [_wrapped(F.col("_lines"), F.col("_held"), t) for t in templates]
    return base.withColumn("_long", numbered).select(
        *columns, "n_words", F.array_sort(F.concat(*places)).alias("phrases"),
        F.array_sort(F.concat(*found)).alias("notices"),
        F.array_sort(F.concat(*runs)).alias("wrapped"),
    )


def _places(words: Column, label: str, phrase: list[str]) -> Column:
    def here(i: Column) -> Column:
        ok = F.get(words, i) == phrase[0]
        for k, word in enumerate(phrase[1:], 1):
            ok = ok & (F.get(words, i + k) == word)
        return ok

    at = F.filter(F.sequence(F.lit(0), F.size(words) - F.lit(len(phrase))), here)
    rows = F.transform(at, lambda i: F.struct(F.lit(label).alias("label"), i.cast("bigint").alias("word")))
    none = F.array().cast("array<struct<label:string,word:bigint>>")
    return F.when(words.isNotNull() & (F.size(words) >= len(phrase)), rows).otherwise(none)


def _notices(blocks: Column, template: Template) -> Column:
    return F.transform(
        F.filter(blocks, lambda x: _matches(x["words"], template)),
        lambda x: F.struct(
            x["block"].alias("block"), F.lit(template.label).alias("label"),
            (F.size(F.array_intersect(x["words"], _strings(template.words))) / F.lit(len(template.words))).alias("share"),
        ),
    )


def _wrapped(lines: Column, held: Column, template: Template) -> Column:
    """Return (first word, label, share) of the runs of words over several of ``lines`` that hold a template.

    Only in texts whose template words ``held`` suffice are runs made. Words of a line that holds the template by itself
    are blanked first, so that no run is found for it. The words are one array's element, or each run would make them anew.
    """
    own, need = _strings(template.words), template.need
    size, step = 2 * template.length, max(template.length // 2, 1)

    def share(words: Column) -> Column:
        return F.size(F.array_intersect(words, own))

    words = F.flatten(F.transform(lines, lambda b: F.when(share(b) < need, b).otherwise(F.transform(b, lambda w: F.lit("")))))

    def rows(words: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(step))
        found = F.transform(
            starts,
            lambda i: F.struct(
                i.cast("bigint").alias("word"), F.lit(template.label).alias("label"),
                (share(F.slice(words, i + 1, F.lit(size))) / F.lit(len(template.words))).alias("share"),
            ),
        )
        return F.filter(found, lambda r: r["share"] >= need / len(template.words))

    none = F.array().cast("array<struct<word:bigint,label:string,share:double>>")
    return F.when(held.isNotNull() & (share(held) >= need), F.flatten(F.transform(F.array(words), rows))).otherwise(none)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses named in all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_licenses(docs, order_templates(docs))
    named = F.transform("phrases", lambda p: p["label"])
    noticed = F.transform("notices", lambda n: n["label"])
    wrapped = F.transform("wrapped", lambda n: n["label"])
    shares = F.concat(F.transform("notices", lambda n: n["share"]), F.transform("wrapped", lambda n: n["share"]))
    starts = F.transform("phrases", lambda p: p["word"])

    def listed(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    return found.select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        listed(named).alias("base_labels"),
        listed(F.concat(named, noticed, wrapped)).alias("labels"),
        F.when(F.size("phrases") > 0, F.lit(1.0))
        .otherwise(F.coalesce(F.array_max(shares), F.lit(0.0)))
        .alias("score"),
    )


def _sql() -> str:
    words = rf"regexp_extract_all(translate({{}}, '{'ABCDEFGHIJKLMNOPQRSTUVWXYZ'}', '{'abcdefghijklmnopqrstuvwxyz'}'), '{WORD}')"
    phrases = " UNION ALL ".join(
        f"SELECT r, '{label}' AS label, unnest(list_filter(range(len(ws)), lambda i: "
        + " AND ".join(f"ws[i + {k}] = '{w}'" for k, w in enumerate(p.split(), 1))
        + ")) AS word FROM docs"
        for label, p in PHRASES.items()
    )
    sets = ", ".join(
        f"('{label}', {sorted(set(re.findall(WORD, t)))}, {len(set(re.findall(WORD, t)))},"
        f" {math.ceil(CONTAINMENT * len(set(re.findall(WORD, t))) - 1e-9)})"
        for label, t in TEMPLATES
    )
    return f"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {words.format("coalesce(text, '')")} AS ws
  FROM documents
), places AS ({phrases}),
blocks AS (SELECT r, list_distinct({words.format("b")}) AS ws FROM (SELECT r, unnest(string_split(t, chr(10))) AS b FROM docs)),
notices AS (
  SELECT r, label, len(list_intersect(ws, words)) / n AS share
  FROM blocks, (VALUES {sets}) AS templates(label, words, n, need) WHERE len(list_intersect(ws, words)) >= need
),
named AS (
  SELECT r, count(*) AS n, min(word) AS lo, max(word) AS hi,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY r
),
listed AS (
  SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT r, label FROM places UNION ALL SELECT r, label FROM notices) GROUP BY r
),
best AS (SELECT r, max(share) AS share FROM notices GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word,
  hi::BIGINT AS last_word, coalesce(named.labels, '') AS base_labels, coalesce(listed.labels, '') AS labels,
  CASE WHEN n > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM docs LEFT JOIN named USING (r) LEFT JOIN listed USING (r) LEFT JOIN best USING (r)
"""


OP3_SQL = _sql()
