"""Session helpers: durable lineage cuts and bounded driver-side lookups."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, Row, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use ``spark.checkpoint.dir`` if the session names one; set an own folder only where none is set.

    The own folder is a local one and therefore only made for a local master (tests);
    on a cluster the shared folder has to be configured.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local[") or sc.master == "local":
        own = tempfile.mkdtemp(prefix="culvert-checkpoint-")
        atexit.register(shutil.rmtree, own, True)
        sc.setCheckpointDir(own)
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    Reliable checkpoints survive the loss of any executor, unlike local ones.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def collect_bounded(df: DataFrame, limit: int, what: str) -> list[Row]:
    """Collect a result whose size is bounded by construction; raise if the bound does not hold."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows")
    return rows
