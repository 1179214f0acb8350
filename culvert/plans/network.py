"""The network plan: tables of a scale folder to nodes, edges and findings of all plan sets and utilities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from culvert.operators import checks, edges, match, merge, quality
from culvert.runtime import durable
from culvert.sources.tables import table


@dataclass
class Network:
    """Nodes after the crown filter, final edges, quality per plan set, and the matched pipes the edges come from."""

    nodes: DataFrame
    edges: DataFrame
    quality: DataFrame
    matched: DataFrame | None = None

    def findings(self) -> DataFrame:
        return checks.run_all_checks(self.nodes, self.edges, self.quality)


def build_network(structures: DataFrame, pipes: DataFrame, tiles: DataFrame) -> Network:
    """Merge, match, last write, crown filter, reversed duplicates, orientation, quality: in this order.

    Nodes, matched pipes and edges are used by many later steps, so they are materialised once each.
    """
    raw_nodes = durable(merge.merged_nodes(structures, tiles))
    matched = durable(match.matched_pipes(durable(match.utility_pipes(pipes, tiles)), raw_nodes))
    drawn = edges.last_write(matched)
    nodes = edges.crown_nodes(raw_nodes)
    e = edges.flag_crowns(drawn, nodes)
    e = edges.reversed_duplicates(e, nodes)
    e = edges.orient_by_gravity(e, nodes)
    records = structures.select("plan_id", "tile_id").unionByName(pipes.select("plan_id", "tile_id"))
    return Network(nodes, durable(e), quality.quality_summary(records, tiles), matched)


def network_of(spark: SparkSession, folder: str) -> Network:
    return build_network(*[table(spark, folder, t) for t in ("structures", "pipes", "tiles")])
