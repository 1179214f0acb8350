"""Extraction quality per plan set.

Edge cases: tiles that only have records, or only a state, count; a missing status is ok; a repeated
tile counts once, as last delivered; an empty plan set has grade D and no row here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from culvert import config as C
from culvert.functions import scalars as S
from culvert.operators.merge import latest_tiles


def quality_summary(records: DataFrame, tiles: DataFrame) -> DataFrame:
    """Counts, grade and warnings per plan set; ``records`` has the (plan_id, tile_id) of all extracted records."""
    seen = records.select("plan_id", "tile_id").dropna().distinct()
    state = latest_tiles(tiles).select("plan_id", "tile_id", F.coalesce("status", F.lit("ok")).alias("status"), F.coalesce("sanitized", F.lit(False)).alias("sanitized"))
    both = seen.join(state, ["plan_id", "tile_id"], "full_outer").withColumn("status", F.coalesce("status", F.lit("ok")))
    q = both.groupBy("plan_id").agg(
        F.count("*").alias("total_tiles"),
        F.count_if(F.col("status") == "ok").alias("ok_tiles"),
        F.count_if((F.col("status") == "ok") & F.coalesce("sanitized", F.lit(False))).alias("sanitized_tiles"),
        F.count_if(F.col("status") == "skipped_low_coherence").alias("skipped_tiles"),
    )
    q = q.withColumn("bad_ratio", (F.col("sanitized_tiles") + F.col("skipped_tiles")) / F.col("total_tiles"))
    # fixed values: the texts of the warnings
    warnings = F.array_compact(
        F.array(
            F.when(F.col("sanitized_tiles") > 0, F.concat(F.col("sanitized_tiles").cast("string"), F.lit(" tiles had sanitizer recovery"))),
            F.when(F.col("skipped_tiles") > 0, F.concat(F.col("skipped_tiles").cast("string"), F.lit(" tiles skipped (low coherence)"))),
            F.when(F.col("bad_ratio") > C.BAD_RATIO, F.lit("Extraction quality below threshold — findings may be incomplete")),
        )
    )
    return q.withColumn("quality_grade", S.quality_grade(F.col("bad_ratio"))).withColumn("warnings", warnings)


def status_counts(tiles: DataFrame) -> DataFrame:
    """Tiles per plan set and normalised status."""
    return latest_tiles(tiles).groupBy("plan_id").agg(*[F.count_if(S.normalize_status(F.col("status")) == s).alias(s) for s in C.STATUSES])
