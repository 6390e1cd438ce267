"""Personal data: pattern spans, and words that give a protected value away by how often they stand beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskaudit.llm import spans
from maskaudit.llm.columns import carried
from maskaudit.llm.scratch import Scratch
from maskaudit.llm.spans import Rule, has, like


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _small_parts(match: Column) -> Column:
    parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


def luhn(digits: Column) -> Column:
    """Return whether a string of digits passes the Luhn check."""
    at = F.sequence(F.lit(1), F.length(digits))
    total = F.aggregate(
        F.zip_with(
            at, F.split(F.reverse(digits), ""), lambda i, d: F.when(i % 2 == 1, d.cast("int")).otherwise(
                F.floor(d.cast("int") / 5).cast("int") + (d.cast("int") * 2) % 10
            )
        ),
        F.lit(0),
        lambda a, x: a + F.coalesce(x, F.lit(0)),
    )
    return total % 10 == 0


def _card(match: Column) -> Column:
    digits = _digits(match)
    return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)


#: The kinds of the contract. Possessive loops match what greedy ones do here, without a stack frame per step; a
#: match can start inside a run of the first part's characters only where the match before it ended.
BASE = (
    Rule(
        "email",
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        has("@"),
    ),
    Rule("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", like(r"[0-9]\.[0-9]"), keep=_small_parts),
    Rule("card", r"[0-9](?:[\x20-]?[0-9])++", like(r"[0-9](?:[\x20-]?[0-9]){13}"), keep=_card),
    Rule(
        "phone", r"\+[0-9][\x20().0-9-]+[0-9]", has("+"),
        keep=lambda match: F.length(_digits(match)).between(10, 15),
    ),
)
WINDOW = 8  # words on each side of a value that count as beside it
SUPPORT = 3  # distinct texts in which a word has to stand beside a value
REMOVE, GENERALISE = 0.95, 0.8  # shares of a value's information that a word gives away
WORD = r"\p{L}{3,}"
TERM = "array<struct<kind:string,value:string,term:string>>"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _beside(text: Column, rule: Rule) -> Column:
    """Return the distinct (kind, value, term) of the words up to WINDOW before and after each kept match."""
    pieces = F.split(text, rule.pattern, -1)
    values = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    around = F.transform(pieces, _words)
    rows = F.transform(
        values,
        lambda v, i: F.transform(
            F.concat(
                F.slice(F.reverse(F.get(around, i)), 1, WINDOW), F.slice(F.get(around, i + 1), 1, WINDOW)
            ),
            lambda term: F.struct(F.lit(rule.kind).alias("kind"), v.alias("value"), term.alias("term")),
        ),
    )
    if rule.keep is not None:
        rows = F.filter(rows, lambda r: F.when(F.size(r) > 0, rule.keep(F.get(r, 0)["value"])).otherwise(False))
    return F.array_distinct(F.flatten(rows))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE, keep: list[str] | None = None) -> DataFrame:
    """Find pattern spans and what stands beside them.

    Adds ``spans_<kind>``, ``_beside`` and ``_hit`` (the text, where it holds a span) and ``_blob`` to the columns
    ``keep`` (default: all but ``text``).
    """
    columns = carried(docs, (*(f"spans_{r.kind}" for r in rules), "spans_term", "sanitised"), keep)
    base = docs.select(*columns, F.coalesce("text", F.lit("")).alias("_text"))
    base = base.withColumns({f"spans_{r.kind}": spans.find(F.col("_text"), r) for r in rules})
    beside = F.concat(
        *[
            F.when(F.size(f"spans_{r.kind}") > 0, _beside(F.col("_text"), r)).otherwise(F.array().cast(TERM))
            for r in rules
        ]
    )
    found = sum((F.size(f"spans_{r.kind}") for r in rules[1:]), F.size(f"spans_{rules[0].kind}")) > 0
    return base.select(
        *columns, *[f"spans_{r.kind}" for r in rules],
        beside.alias("_beside"),
        F.when(found, F.col("_text")).alias("_hit"),
        # A key of its own for texts without values, or all of them would meet in one task of a later join.
        F.when(found, F.sha2("_text", 256)).otherwise(F.concat(F.lit("-"), F.hex(F.xxhash64(*columns, "_text")))).alias("_blob"),
    )


def disclosures(
    scanned: DataFrame, docs: DataFrame, rules: tuple[Rule, ...] = BASE, support: int = SUPPORT,
    generalise: float = GENERALISE, remove: float = REMOVE,
) -> DataFrame:
    """Return (kind, value, term, share, action) of the terms that give a value away.

    With N rows, n(v) of them holding the value, n(v, t) with the term beside it and n(t) holding the term, the
    pointwise mutual information log(N n(v, t) / (n(v) n(t))) over the information log(N / n(v)) of the value is the
    share that the term reveals. All counts run over all rows; terms beside a value in fewer than ``support``
    distinct texts are left alone, as are values that every row holds. Before all words are counted, terms go whose
    share is too small even if n(t) were only the rows that hold the term beside some value, as most frequent words'.
    """
    scratch = Scratch(docs.sparkSession)
    n_rows = float(max(docs.count(), 1))

    def share(n_term: Column) -> Column:
        information = F.log(F.lit(n_rows) / F.col("n_value"))
        mutual = F.log(F.col("n_joint") * F.lit(n_rows) / (F.col("n_value") * n_term))
        return F.when(information > 0, mutual / information).otherwise(0.0)

    def values(column: str) -> Column:
        kind = F.lit(column.removeprefix("spans_")).alias("kind")
        return F.transform(column, lambda s: F.struct(kind, s["value"].alias("value")))

    rows = scanned.where(F.col("_hit").isNotNull())
    near = rows.select("_blob", F.explode("_beside").alias("x")).select("_blob", "x.*")
    joint = (
        near.groupBy("kind", "value", "term", "_blob").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("kind", "value", "term")
        .agg(F.sum("n").alias("n_joint"), F.count(F.lit(1)).alias("n_texts"))
        .where(F.col("n_texts") >= support)
    )
    with_value = (
        rows.select(F.explode(F.array_distinct(F.concat(*[values(f"spans_{r.kind}") for r in rules]))).alias("x"))
        .select("x.*")
        .groupBy("kind", "value")
        .agg(F.count(F.lit(1)).alias("n_value"))
    )
    beside_any = (
        rows.select(F.explode(F.array_distinct(F.transform("_beside", lambda b: b["term"]))).alias("term"))
        .groupBy("term").agg(F.count(F.lit(1)).alias("n_near"))
    )
    joint = scratch.put(
        joint.join(with_value, ["kind", "value"]).join(beside_any, "term").where(share(F.col("n_near")) >= generalise)
    )
    with_term = (
        docs.select(F.explode(F.array_distinct(_words(F.col("text")))).alias("term"))
        .join(joint.select("term").distinct(), "term", "left_semi")
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("n_term"))
    )
    shares = joint.join(with_term, "term").withColumn("share", share(F.col("n_term"))).where(F.col("share") >= generalise)
    return shares.select(
        "kind", "value", "term", "share",
        F.when(F.col("share") >= remove, "remove").otherwise("generalise").alias("action"),
    )


def _places(text: Column, terms: Column) -> Column:
    """Return the spans of the words of ``text`` that are keys of the map ``terms``."""
    parts = F.zip_with(
        F.split(text, WORD, -1),
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
        lambda gap, match: F.struct(
            F.length(gap).cast("bigint").alias("gap"), F.length(match).cast("bigint").alias("size"), match.alias("value")
        ),
    )
    found = spans.starts_of(F.filter(parts, lambda x: x["value"].isNotNull()))
    return F.filter(found, lambda s: F.map_contains_key(terms, F.lower(s["value"])))


def sanitise(docs: DataFrame, rules: tuple[Rule, ...] = BASE, keep: list[str] | None = None, **thresholds) -> DataFrame:
    """Find personal data and what gives it away in ``docs`` (with ``text``), and return the sanitised texts.

    Returns ``keep`` (default: all columns but ``text``), ``spans_<kind>`` per rule, ``spans_term`` (words that
    disclose a value beside them, outside pattern spans, value: the action) and ``sanitised``: values become
    ``<kind>``, generalised words ``<term>``, removed words nothing; NULL where the text holds no value and stays.

    NULL text counts as empty, rows that repeat and NULL ids are kept, an empty table gives no row; see ``carried`` for
    names that clash.
    """
    scratch = Scratch(docs.sparkSession)
    scanned = scratch.put(scan(docs, rules, keep))
    columns = carried(docs, (*(f"spans_{r.kind}" for r in rules), "spans_term", "sanitised"), keep)
    flagged = scratch.put(disclosures(scanned, docs, rules, **thresholds))
    near = scanned.where(F.size("_beside") > 0).select("_blob", "_hit", F.explode("_beside").alias("x"))
    per_text = (
        near.select("_blob", "x.*").distinct()
        .join(flagged, ["kind", "value", "term"])
        .groupBy("_blob", "term").agg(F.min("action").alias("action"))  # to generalise wins over to remove
        .groupBy("_blob").agg(F.map_from_entries(F.collect_list(F.struct("term", "action"))).alias("_terms"))
        .withColumnRenamed("_blob", "_of")
    )
    joined = scanned.join(per_text, F.col("_blob") == F.col("_of"), "left")
    values = F.concat(*[F.col(f"spans_{r.kind}") for r in rules])
    words = F.when(
        F.col("_terms").isNotNull(),
        F.transform(
            F.filter(
                _places(F.col("_hit"), F.col("_terms")),
                lambda w: ~F.exists(values, lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"])),
            ),
            lambda w: F.struct(
                w["start"].alias("start"), w["end"].alias("end"),
                F.element_at(F.col("_terms"), F.lower(w["value"])).alias("value"),
            ),
        ),
    ).otherwise(F.array().cast(spans.SPAN))
    joined = joined.withColumn("spans_term", words)
    return joined.select(
        *columns, *[f"spans_{r.kind}" for r in rules], "spans_term", _rewritten(rules).alias("sanitised")
    )


def _rewritten(rules: tuple[Rule, ...]) -> Column:
    def put(column: Column, mark: Column | None) -> Column:
        return F.transform(
            column,
            lambda s: F.struct(
                s["start"].alias("start"), s["end"].alias("end"),
                (F.when(s["value"] == "generalise", "<term>").otherwise("") if mark is None else mark).alias("mark"),
            ),
        )

    edits = F.concat(*[put(F.col(f"spans_{r.kind}"), F.lit(f"<{r.kind}>")) for r in rules], put(F.col("spans_term"), None))
    return spans.rewrite(F.col("_hit"), edits)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents, with the words that give it away."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = sanitise(docs)
    base = {r.kind: F.col(f"spans_{r.kind}") for r in BASE}
    return found.select(
        "doc_id",
        *[F.size(column).cast("bigint").alias(f"n_{kind}") for kind, column in base.items()],
        F.sha2(spans.listing(base), 256).alias("base_sha256"),
        spans.listing(base | {"term": F.col("spans_term")}).alias("spans"),
    )
