"""Package validation: artifacts against their status, declared against recomputed counts, quality gate.

Edge cases: a repeated tile is one duplicate error; an unknown status is a runtime error; a plan set without paired
tiles has ratio 0; null counts are 0; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from culvert import config as C
from culvert.functions import scalars as S


def artifacts(tiles: DataFrame, layers: DataFrame, records: DataFrame) -> DataFrame:
    """One row per delivered tile with what exists for it; ``records`` has (plan_id, tile_id) of extracted records."""
    key = ["plan_id", "tile_id"]
    has = lambda df, name: df.select(*key).dropna().distinct().withColumn(name, F.lit(True))
    t = tiles.groupBy(*key).agg(F.count("*").alias("deliveries"), F.max_by(F.struct("status", "sanitized", "page_number"), F.struct(F.coalesce(F.col("ingested_at").cast("timestamp"), F.lit(0).cast("timestamp")).alias("a"), F.coalesce(F.col("status"), F.lit("")).alias("b"))).alias("t"))
    return (
        t.select(*key, "deliveries", S.normalize_status(F.col("t.status")).alias("status"), F.coalesce("t.sanitized", F.lit(False)).alias("sanitized"), F.col("t.page_number").alias("page_number"))
        .join(has(layers, "has_layer"), key, "left")
        .join(has(records, "has_records"), key, "left")
        .na.fill(False, ["has_layer", "has_records"])
    )


def artifact_messages(rows: DataFrame) -> DataFrame:
    """Critical errors and warnings of each artifact."""
    s = F.col("status")
    say = lambda cond, text: F.when(cond, F.concat(F.col("tile_id"), F.lit(": " + text), s))
    critical = F.array_compact(
        F.array(
            F.when(F.col("deliveries") > 1, F.concat(F.lit("duplicate tile_id in package: "), "tile_id")),
            say(~F.col("has_layer") & (s != "missing_text_layer"), "missing text layer for status="),
            say((s == "ok") & ~F.col("has_records"), "extraction required for status="),
            say(S.page_of_tile(F.col("tile_id")).isNotNull() & (S.page_of_tile(F.col("tile_id")) != F.col("page_number")), "page number mismatch for status="),
        )
    )
    warnings = F.array_compact(
        F.array(
            say((s == "missing_text_layer") & F.col("has_layer"), "text layer exists for status="),
            say(s.isin("dry_run", "skipped_low_coherence", "missing_text_layer") & F.col("has_records"), "extraction present for status="),
        )
    )
    return rows.withColumn("critical", critical).withColumn("warnings", warnings)


def declared_counts(tiles: DataFrame, structures: DataFrame, pipes: DataFrame, callouts: DataFrame) -> DataFrame:
    """Declared and recomputed numbers of records per tile (largest declaration of its deliveries)."""
    key = ["plan_id", "tile_id"]
    n = lambda df, name: df.groupBy(*key).agg(F.count("*").alias(name))
    t = tiles.dropna(subset=key).groupBy(*key).agg(*[F.max(F.coalesce(f"{k}_count", F.lit(0))).alias(f"declared_{k}") for k in ("structures", "pipes", "callouts")])
    for df, k in ((structures, "structures"), (pipes, "pipes"), (callouts, "callouts")):
        t = t.join(n(df, f"found_{k}"), key, "left")
    t = t.na.fill(0, [f"found_{k}" for k in ("structures", "pipes", "callouts")])
    return t.withColumn("agrees", (F.col("declared_structures") == F.col("found_structures")) & (F.col("declared_pipes") == F.col("found_pipes")) & (F.col("declared_callouts") == F.col("found_callouts")))


def package_report(tiles: DataFrame, layers: DataFrame, records: DataFrame, warn: float = C.PACKAGE_WARN, fail: float = C.PACKAGE_FAIL) -> DataFrame:
    """Quality and verdict of each plan set: fail on any critical error, warn on any warning, else pass."""
    a = artifact_messages(artifacts(tiles, layers, records))
    q = a.groupBy("plan_id").agg(
        F.count("*").alias("artifacts"),
        F.count_if(F.col("status") != "missing_text_layer").alias("paired_tiles"),
        F.count_if("sanitized").alias("sanitized_tiles"),
        F.count_if(F.col("status") == "skipped_low_coherence").alias("skipped_tiles"),
        F.sum(F.size("critical")).cast("bigint").alias("critical_errors"),
        F.sum(F.size("warnings")).cast("bigint").alias("warnings"),
    )
    q = q.withColumn("bad_ratio", F.when(F.col("paired_tiles") > 0, (F.col("sanitized_tiles") + F.col("skipped_tiles")) / F.col("paired_tiles")).otherwise(F.lit(0.0)))
    q = q.withColumn("critical_errors", F.col("critical_errors") + (F.col("bad_ratio") > fail).cast("int")).withColumn("warnings", F.col("warnings") + ((F.col("bad_ratio") > warn) & (F.col("bad_ratio") <= fail)).cast("int"))
    return q.withColumn("verdict", F.when(F.col("critical_errors") > 0, "fail").when(F.col("warnings") > 0, "warn").otherwise("pass"))


def verify_hashes(expected: DataFrame, files: DataFrame) -> DataFrame:
    """Expected digests ``(path, sha256)`` against files ``(path, content)``; rows that differ or are missing."""
    got = files.select("path", F.sha2("content", 256).alias("actual"))
    j = expected.filter("sha256 is not null and sha256 <> ''").join(got, "path", "left")
    return j.filter("actual is null or actual <> sha256").withColumn("message", F.when(F.col("actual").isNull(), "file is missing").otherwise("hash mismatch"))


def submitted_minus_returned(submitted: DataFrame, returned: DataFrame, key: str) -> DataFrame:
    """Keys that were submitted but not returned, and returned but not submitted."""
    lost = submitted.select(key).distinct().join(returned.select(key).distinct(), key, "left_anti").withColumn("state", F.lit("not_returned"))
    alien = returned.select(key).distinct().join(submitted.select(key).distinct(), key, "left_anti").withColumn("state", F.lit("unknown"))
    return lost.unionByName(alien)
