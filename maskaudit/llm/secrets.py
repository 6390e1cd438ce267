"""Secret scans: a ledger of content-addressed blobs, of which only unseen (blob, rule version) pairs are scanned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskaudit.llm import spans
from maskaudit.llm.columns import carried
from maskaudit.llm.scratch import Scratch
from maskaudit.llm.spans import Rule, has, like

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def _any_case(*words: str):
    return lambda text: has(*words)(F.lower(text))


#: The kinds of the contract first, in its order.
BASE = (
    Rule(
        "assign", ASSIGN, _any_case("password", "passwd", "secret", "token", "apikey", "api_key"),
        keep=lambda match: F.length(F.regexp_extract(match, ASSIGN, 1)) >= 8,
    ),
    Rule("access", r"AKIA[A-Z0-9]{12,}", has("AKIA")),
    Rule("hex", r"[0-9a-f]{32,}", like(r"[0-9a-f]{32}")),
)
PEM_LINE = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
_EOL = r"(?:\r?\n|\r|\\r\\n|\\n)"  # as such or escaped
_TAIL = r"""[\x20\t"',;]*+"""
_LINE = (
    rf"(?:[A-Za-z0-9+/=_]++(?={_TAIL}(?:{_EOL}|\z))|[A-Za-z0-9+/=_]{{40,}}+"
    r"|(?:Proc-Type|DEK-Info|Comment|Version):[^\r\n\\]*+)"
)
#: A private key from its first line to its END line, or without one over the base64 lines that follow.
PEM = (
    rf"{PEM_LINE}(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]{{0,40}}PRIVATE KEY-----"
    rf"|(?:{_TAIL}(?:{_EOL}[\x20\t>#*|\"']*+)++{_LINE}|\x20++[A-Za-z0-9+/=_]{{40,}}+)*+)"
)
MORE = (
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", has("eyJ")),
    Rule("pem", PEM, has("PRIVATE KEY-----"), version=2),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}+", has("gho_", "ghp_", "ghs_", "ghu_")),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}+", has("xox")),
)
RULES = BASE + MORE
LEDGER = "blob string, rule string, version int, spans array<struct<start:bigint,end:bigint>>"


def blob_id(text: Column) -> Column:
    """Return the content address of a text; NULL counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what ``ledger`` has not seen of ``versions`` (one row per stored version, with ``text``).

    Returns new ledger rows: ``blob``, ``rule``, ``version``, ``spans`` (code points, end exclusive; may be empty, as
    a scan without findings is remembered too). Every distinct text is scanned once per rule version, however many
    paths or versions hold it. NULL text is the empty blob; other columns are ignored; an empty table gives no row.
    """
    blobs = (
        versions.select(blob_id(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
        .dropDuplicates(["blob"])
    )
    todo = F.array(*[F.lit(r.kind) for r in rules])
    if ledger is None:
        blobs = blobs.withColumn("_todo", todo)
    else:
        known = ledger.where(
            F.concat_ws(":", "rule", F.col("version").cast("string")).isin([f"{r.kind}:{r.version}" for r in rules])
        ).groupBy("blob").agg(F.collect_set("rule").alias("_known"))
        blobs = (
            blobs.join(known, "blob", "left")
            .withColumn("_todo", F.array_except(todo, F.coalesce("_known", F.array().cast("array<string>"))))
            .where(F.size("_todo") > 0)
        )
    text, pairs = F.col("text"), []
    for rule in rules:
        found = F.when(F.array_contains("_todo", rule.kind), spans.find(text, rule))
        pairs.append(
            F.struct(
                F.lit(rule.kind).alias("rule"),
                F.lit(rule.version).alias("version"),
                F.transform(found, lambda s: F.struct(s["start"], s["end"])).alias("spans"),
            )
        )
    rows = blobs.select("blob", F.explode(F.array(*pairs)).alias("p"))
    return rows.select("blob", "p.rule", "p.version", "p.spans").where(F.col("spans").isNotNull())


def findings_by_path(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Join the ledger's findings of ``rules`` back to every row of ``versions``.

    Adds one column per rule, ``spans_<kind>`` (empty where nothing was found), to the other columns of ``versions``.
    """
    current = F.lit(False)
    for rule in rules:
        current = current | ((F.col("rule") == rule.kind) & (F.col("version") == rule.version))
    found = ledger.where(current & (F.size("spans") > 0)).groupBy("blob")
    found = found.agg(F.map_from_entries(F.collect_list(F.struct("rule", "spans"))).alias("_found"))
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return (
        versions.join(found.withColumnRenamed("blob", "_blob"), F.col("_blob") == F.col("_version_blob"), "left")
        .withColumns(
            {f"spans_{r.kind}": F.coalesce(F.try_element_at("_found", F.lit(r.kind)), empty) for r in rules}
        )
        .drop("_blob", "_found", "_version_blob")
    )


def scan(
    versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, keep: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Return (findings by path, new ledger rows), the ledger written to the shared folder before it is joined.

    ``keep`` names the columns of ``versions`` the findings carry (default: all but ``text``). Rows that repeat and
    NULL ids are kept as they come; see ``carried`` for names that clash.
    """
    fresh = Scratch(versions.sparkSession).put(scan_unseen(versions, ledger, rules))
    columns = carried(versions, tuple(f"spans_{r.kind}" for r in rules), keep)
    paths = versions.select(*columns, blob_id(F.col("text")).alias("_version_blob"))
    return findings_by_path(paths, fresh if ledger is None else ledger.unionByName(fresh), rules), fresh


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Return ``docs`` with every secret in ``text`` replaced by ``<kind>``; ``n_chars`` follows where it is there."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    found, _ = scan(rows, None, rules)

    def marked(rule: Rule) -> Column:
        mark = F.lit(f"<{rule.kind}>").alias("mark")
        return F.transform(f"spans_{rule.kind}", lambda s: F.struct(s["start"], s["end"], mark))

    found = found.select("row", F.concat(*[marked(r) for r in rules]).alias("edits"))
    text = F.when(F.size("edits") > 0, spans.rewrite(F.col("row.text"), F.col("edits"))).otherwise(F.col("row.text"))
    found = found.select("row", F.size("edits").alias("edits"), text.alias("new"))
    out = []
    for f in docs.schema.fields:
        column = F.col(f"row.`{f.name}`")
        if f.name == "text":
            column = F.col("new")
        elif f.name == "n_chars":
            column = F.when(F.col("edits") > 0, F.length("new").cast(f.dataType)).otherwise(column)
        out.append(column.alias(f.name))
    return found.select(*out)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, scanned once per distinct text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found, _ = scan(docs)
    base = {r.kind: F.col(f"spans_{r.kind}") for r in BASE}
    return found.select(
        "doc_id",
        *[F.size(column).cast("bigint").alias(f"n_{kind}") for kind, column in base.items()],
        F.sha2(spans.listing(base), 256).alias("base_sha256"),
        spans.listing({r.kind: F.col(f"spans_{r.kind}") for r in RULES}).alias("spans"),
    )


def _sql_kind(kind: str, pattern: str, keep: str = "true") -> str:
    """SQL that lists (row, kind, start, end) of one kind's matches: pieces between matches give the places."""
    return f"""
  SELECT r, '{kind}' AS kind, s AS start, s + length(m) AS stop FROM (
    SELECT r, unnest(list_transform(range(1, len(ms) + 1), lambda i: list_sum(list_transform(ps[1:i], lambda p: length(p)))
        + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0)))::BIGINT AS s, unnest(ms) AS m
    FROM (SELECT r, string_split_regex(t, '{pattern}') AS ps, regexp_extract_all(t, '{pattern}') AS ms FROM docs)
  ) WHERE {keep}"""


_ASSIGN_SQL = (
    r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
)
OP5_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join([
    _sql_kind("assign", _ASSIGN_SQL, f"length(regexp_extract(m, '{_ASSIGN_SQL}', 1)) >= 8"),
    _sql_kind("access", "AKIA[A-Z0-9]+", "length(m) >= 16"),
    _sql_kind("hex", "[0-9a-f]{32,}"),
    _sql_kind("jwt", MORE[0].pattern.replace("}+", "}")),
    _sql_kind("pem", PEM_LINE),
    _sql_kind("github", MORE[2].pattern.replace("}+", "}")),
    _sql_kind("slack", MORE[3].pattern.replace("}+", "}")),
])}),
ranked AS (SELECT *, list_position(['assign', 'access', 'hex', 'jwt', 'pem', 'github', 'slack'], kind) AS k FROM found)
SELECT doc_id,
  count(*) FILTER (k = 1) AS n_assign, count(*) FILTER (k = 2) AS n_access, count(*) FILTER (k = 3) AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) FILTER (k <= 3), ''))
    AS base_sha256,
  coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) FILTER (k >= 1), '') AS spans
FROM docs LEFT JOIN ranked USING (r) GROUP BY r, doc_id
"""
