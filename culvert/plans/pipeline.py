"""Phase runner: validation, network, checks and report of a folder of tables, with resume.

A phase is skipped when its output is complete (the committer's success mark).  A failed validation verdict stops the run
only if ``gate`` is set.
"""

from __future__ import annotations

import os
import time

from pyspark.sql import SparkSession

from culvert.operators import report, validation
from culvert.plans.network import Network, build_network
from culvert.sources.sinks import write_small_json
from culvert.sources.tables import table


class GateFailed(RuntimeError):
    """A plan set failed validation."""


def _done(path: str) -> bool:
    return os.path.exists(os.path.join(path, "_SUCCESS"))


def run(spark: SparkSession, folder: str, out: str, *, gate: bool = False, resume: bool = True) -> dict:
    """Runs all phases; returns and writes the run's metadata."""
    started, phases = time.time(), {}
    read = lambda name: table(spark, folder, name)

    def phase(name: str, make) -> str:
        path = os.path.join(out, name)
        if resume and _done(path):
            phases[name] = "skipped"
        else:
            make().write.mode("overwrite").parquet(path)
            phases[name] = "done"
        return path

    os.makedirs(out, exist_ok=True)
    records = lambda: read("structures").select("plan_id", "tile_id").unionByName(read("pipes").select("plan_id", "tile_id"))
    checked = phase("validation", lambda: validation.package_report(read("tiles"), read("text_layers"), records()))
    if gate and spark.read.parquet(checked).filter("verdict = 'fail'").limit(1).count():
        raise GateFailed(checked)
    built: list[Network] = []

    def network() -> Network:
        if not built:
            built.append(build_network(read("structures"), read("pipes"), read("tiles")))
        return built[0]

    nodes = phase("nodes", lambda: network().nodes)
    edges = phase("edges", lambda: network().edges)
    quality = phase("quality", lambda: network().quality)
    stored = Network(*[spark.read.parquet(p) for p in (nodes, edges, quality)])
    found = phase("findings", stored.findings)
    phase("report", lambda: report.findings_report(spark.read.parquet(found)))
    meta = {"folder": folder, "phases": phases, "seconds": round(time.time() - started, 3)}
    write_small_json(meta, os.path.join(out, "run.json"))
    return meta
