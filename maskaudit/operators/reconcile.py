"""Compare what is listed with what is there: layouts, manifests, digests and stored rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskaudit.functions import scalars as S
from maskaudit.session import spread

FAN_IN = 4096
RUN_LEVELS = 4  # runs of runs of scores: 4096**4 positions before one group is longer
PREFIXES = (8, 6, 4, 2)  # hex digits of a path's md5 that a part of a manifest shares


def reconcile_paths(expected: DataFrame, found: DataFrame, path: str = "path") -> DataFrame:
    """A2: every missing and every unexpected path; hidden files and folders do not count."""
    hidden = F.col(path).rlike(r"(^|/)\.")
    left = expected.select(path).distinct().withColumn("_e", F.lit(True))
    right = found.where(~hidden).select(path).distinct().withColumn("_f", F.lit(True))
    both = left.join(right, path, "full_outer")
    problem = F.when(F.col("_f").isNull(), "missing").when(F.col("_e").isNull(), "unexpected")
    return both.select(path, problem.alias("problem")).where("problem IS NOT NULL")


def mask_domain_violations(values: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """A3: files whose mask holds anything but 0 and 255, with the offending 8-bit values."""
    return (
        values.where(~F.col(value).isin(0, 255))
        .groupBy(*keys)
        .agg(F.array_join(F.array_sort(F.collect_set(F.col(value))), ",").alias("found"))
    )


def parse_manifest(lines: DataFrame, line: str, line_number: str) -> DataFrame:
    """A4: path and digest per manifest line; bad lines and repeated paths carry a problem.

    Blank lines are dropped.
    """
    digest = F.regexp_extract(line, S.MANIFEST_LINE, 1)
    path = F.regexp_extract(line, S.MANIFEST_LINE, 2)
    parsed = lines.where(F.trim(line) != "").select(
        line_number, F.nullif(path, F.lit("")).alias("path"), F.nullif(digest, F.lit("")).alias("digest")
    )
    repeated = (
        parsed.where("path IS NOT NULL")
        .groupBy("path")
        .agg(F.min(line_number).alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1")
        .drop("_n")
    )
    problem = F.when(F.col("path").isNull(), "malformed").when(
        F.col(line_number) > F.col("_first"), "listed twice"
    )
    return parsed.join(repeated, "path", "left").select(
        line_number, "path", "digest", problem.alias("problem")
    )


def manifest_line(path: Column, digest: Column) -> Column:
    """A5: ``<digest>  <path>``."""
    return F.concat(digest, F.lit("  "), path)


def verify_checksums(expected: DataFrame, actual: DataFrame, datasets: Sequence[str] | None = None) -> DataFrame:
    """Missing, mismatched and unlisted paths, restricted to the named datasets; unknown ones are an error."""
    wanted, found = expected.select("path", "digest"), actual.select("path", "digest")
    if datasets is not None:
        if not datasets:
            raise ValueError("no dataset locations given to verify")
        unknown = [r["dataset"] for r in unknown_datasets(expected, datasets).collect()]
        if unknown:
            raise ValueError(f"the manifest lists nothing of {sorted(unknown)}")
        chosen = S.path_prefix(F.col("path")).isin(list(datasets))
        wanted, found = wanted.where(chosen), found.where(chosen)
    both = wanted.withColumnRenamed("digest", "_want").join(
        found.withColumnRenamed("digest", "_have"), "path", "full_outer"
    )
    problem = (
        F.when(F.col("_have").isNull(), "missing")
        .when(F.col("_want").isNull(), "unlisted")
        .when(F.col("_want") != F.col("_have"), "mismatched")
    )
    return both.select("path", problem.alias("problem")).where("problem IS NOT NULL")


def unknown_datasets(expected: DataFrame, datasets: Sequence[str]) -> DataFrame:
    """Named datasets the manifest has no entry for."""
    rows = [(d,) for d in datasets]
    named = expected.sparkSession.createDataFrame(rows, "dataset string")
    known = expected.select(S.path_prefix(F.col("path")).alias("dataset")).distinct()
    return named.join(known, "dataset", "left_anti")


def data_hash(entries: DataFrame, groups: Sequence[str]) -> DataFrame:
    """One digest per group over its manifest lines, independent of row order, defined alike at every size.

    Lines are parted by eight hex digits of the md5 of their path; a part's digest is that of its lines in order of
    path. Parts that share six, four, two and no digits are digested in turn, in order of their digits. So no task
    holds more than 256 digests, or the lines that share 32 bits.
    """
    line = F.concat(manifest_line(F.col("path"), F.col("digest")), F.lit("\n"))
    level = entries.select(
        *groups, F.substring(F.md5("path"), 1, PREFIXES[0]).alias("_part"), F.col("path").alias("_key"),
        line.alias("_text"), F.lit(1).cast("bigint").alias("_n"),
    )
    for digits in (*PREFIXES[1:], 0):
        rows = F.array_sort(F.collect_list(F.struct("_key", "_text")))
        level = (
            level.groupBy(*groups, "_part")
            .agg(F.sha2(F.array_join(F.transform(rows, lambda s: s["_text"]), ""), 256).alias("_text"), F.sum("_n").alias("_n"))
            .select(*groups, F.substring("_part", 1, digits).alias("_part"), F.col("_part").alias("_key"), "_text", "_n")
        )
    rows = F.array_sort(F.collect_list(F.struct("_key", "_text")))
    return level.groupBy(*groups).agg(
        F.sum("_n").alias("n_lines"),
        F.sha2(F.array_join(F.transform(rows, lambda s: s["_text"]), ""), 256).alias("data_hash"),
    )


def exact_text(score: Column) -> Column:
    """A FLOAT as three integers, whose value is theirs in units of 2**-30, 2**-90 and 2**-150."""
    unit = score.cast("double") * F.lit(float(1 << 30))
    first = F.floor(unit)
    rest = (unit - first) * F.lit(float(1 << 60))
    second = F.floor(rest)
    third = (rest - second) * F.lit(float(1 << 60))
    return F.concat_ws(".", *[x.cast("bigint").cast("string") for x in (first, second, third)])


def score_digest(scored: DataFrame, keys: Sequence[str], position: Column) -> DataFrame:
    """One digest per item over its scores in position order.

    Scores are hashed in runs of 4,096 positions, the run digests in runs of 4,096 again, and so on, so no group is
    longer than 4,096 up to 2**48 positions.
    """
    # A FLOAT in [0, 1] is a whole number of units of 2**-150, written in three parts that are the same everywhere.
    level = scored.select(*keys, position.cast("bigint").alias("_p"), exact_text(F.col("prob")).alias("_v"))
    for _ in range(RUN_LEVELS):
        group = F.floor(F.col("_p") / F.lit(FAN_IN)).cast("bigint")
        level = (
            level.groupBy(*keys, group.alias("_q"))
            .agg(F.array_sort(F.collect_list(F.struct("_p", "_v"))).alias("_s"))
            .select(
                *keys,
                F.col("_q").alias("_p"),
                F.sha2(F.array_join(F.transform("_s", lambda s: s["_v"]), ","), 256).alias("_v"),
            )
        )
    ordered = F.array_sort(F.collect_list(F.struct("_p", "_v")))
    return level.groupBy(*keys).agg(
        F.sha2(F.array_join(F.transform(ordered, lambda s: s["_v"]), ","), 256).alias("digest")
    )


def canonical_json(config: Column) -> Column:
    """JSON with the keys of every object in order and no blanks between tokens; types stay apart."""
    return F.to_json(F.parse_json(config))


def config_hash(configs: DataFrame, key: str, config: str) -> DataFrame:
    """A10: a hash of a JSON text that depends on neither the order of keys, at any depth, nor blanks."""
    return configs.select(key, F.sha2(canonical_json(F.col(config)), 256).alias("config_hash"))


def classify_upsert(incoming: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mark each incoming row new, same (already stored as is) or conflict."""
    values = [c for c in incoming.columns if c not in keys]
    old = stored.select(*keys, F.struct(*values).alias("_old"), F.lit(True).alias("_there"))
    same = F.struct(*values).eqNullSafe(F.col("_old"))
    status = F.when(F.col("_there").isNull(), "new").when(same, "same").otherwise("conflict")
    return incoming.join(old, [*keys], "left").select(*incoming.columns, status.alias("status"))


def fill_evaluation(
    stored: DataFrame, records: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Stored rows with the evaluation columns of their record; others stay as they are."""
    new = records.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in columns], F.lit(True).alias("_has"))
    joined = stored.join(new, [*keys], "left")
    return joined.select(
        *[
            F.when(F.col("_has"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
            for c in stored.columns
        ]
    )


def unfillable(stored: DataFrame, records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Records without exactly one stored row; nothing may be written while there are any.

    The stored rows are counted first and exchanged by key into as many partitions as they need, which the records follow.
    """
    matches = spread(stored.select(*keys), keys, stored.count()).groupBy(*keys).agg(F.count("*").alias("n_rows"))
    return (
        records.select(*keys)
        .join(matches, [*keys], "left")
        .withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
        .where("n_rows <> 1")
    )


def compare_rows(
    stored: DataFrame, computed: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Keys whose stored and recomputed columns differ, or that only one side has."""
    left = stored.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in columns], F.lit(True).alias("_s"))
    right = computed.select(*keys, *[F.col(c).alias(f"_c_{c}") for c in columns], F.lit(True).alias("_c"))
    differing = [
        F.when(~F.col(f"_s_{c}").eqNullSafe(F.col(f"_c_{c}")), F.lit(c)) for c in columns
    ]
    names = F.array_join(F.array_compact(F.array(*differing)), ",")
    problem = (
        F.when(F.col("_s").isNull(), "not stored")
        .when(F.col("_c").isNull(), "not recomputed")
        .when(names != "", F.concat(F.lit("differs: "), names))
    )
    return (
        left.join(right, [*keys], "full_outer")
        .select(*keys, problem.alias("problem"))
        .where("problem IS NOT NULL")
    )


def compare_digests(
    expected: DataFrame, actual: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Q12, Q13: keys whose digest is missing, extra or different."""
    both = expected.select(*keys, F.col("digest").alias("_want"), F.lit(True).alias("_e")).join(
        actual.select(*keys, F.col("digest").alias("_have"), F.lit(True).alias("_a")),
        [*keys],
        "full_outer",
    )
    problem = (
        F.when(F.col("_a").isNull(), "missing")
        .when(F.col("_e").isNull(), "unexpected")
        .when(~F.col("_want").eqNullSafe(F.col("_have")), "mismatch")
    )
    return both.select(*keys, problem.alias("problem")).where("problem IS NOT NULL")
