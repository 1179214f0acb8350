"""Streaming over tile deliveries: status counts by event time, and incremental network rebuilds.

The batch operators are reused; a rebuild reads only the plan sets named in the micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from culvert.functions import scalars as S
from culvert.plans.network import Network, build_network


def status_windows(deliveries: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Deliveries per status and window of ``ingested_at``; later rows than the watermark are dropped by design."""
    timed = deliveries.withColumn("at", F.col("ingested_at").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window).alias("w"), S.normalize_status(F.col("status")).alias("status")).agg(F.count("*").alias("deliveries")).select(F.col("w.start").alias("window_start"), "status", "deliveries")


def rebuild_on_delivery(structures: DataFrame, pipes: DataFrame, tiles: DataFrame, sink: Callable[[Network, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that rebuilds the networks of the plan sets a micro-batch touches."""

    def run(batch: DataFrame, batch_id: int) -> None:
        touched = batch.select("plan_id").dropna().distinct()
        only = lambda df: df.join(touched, "plan_id", "left_semi")
        sink(build_network(only(structures), only(pipes), only(tiles)), batch_id)

    return run
