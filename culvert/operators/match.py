"""Pipe ends matched to structure nodes: by hint text, then by nearest station.

Candidates of a pipe end are the nodes of its page (of the whole plan set and utility where the page has
none).  The rank is hint score, then distance, then node id; the ``to`` end must not take the node of
the ``from`` end.  If exactly one end is missing it is inferred from the pipe's length, never better than
``low``; what is still missing becomes an orphan anchor.

Scale: ends are reduced to distinct requests (page, station, hint) before the candidate join, and
the join is reduced at once by a partially aggregated minimum, so no pair is ever shuffled or
kept.  Pages bound the candidates.

Edge cases: an end without station and hint is not matched; empty hints are none; pipes of no known
utility are left out; ties go to the smaller node id; empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from culvert import config as C
from culvert.functions import scalars as S
from culvert.operators.merge import latest_tiles
from culvert.runtime import durable

PIPE_COLUMNS = [
    "pipe_id", "plan_id", "tile_id", "page_number", "pipe_type", "size", "material", "length_lf", "slope", "from_station", "to_station", "from_structure_hint", "to_structure_hint", "notes", "source_text_ids",
]
PAGE = ["plan_id", "utility", "page_number"]
FAR = float("inf")


def utility_pipes(pipes: DataFrame, tiles: DataFrame) -> DataFrame:
    """Pipes of the known utilities with their number in load order, parsed ends and tile state.

    The number is the pipe's rank within its tile plus the pipes of all earlier tiles, so only counts per
    tile are ordered over a plan set.
    """
    meta = latest_tiles(tiles).select("plan_id", "tile_id", F.coalesce("sanitized", F.lit(False)).alias("sanitized"), F.coalesce("coherence_score", F.lit(1.0)).alias("source_coherence"), F.lower(F.trim("sheet_type")).alias("sheet_type"))
    utility = F.upper(F.trim("pipe_type"))
    pipes = pipes.select(*PIPE_COLUMNS)
    p = pipes.filter("plan_id is not null and page_number is not null and tile_id is not null").withColumn("utility", utility).filter(F.col("utility").isin(*C.UTILITIES))
    tile = ["plan_id", "utility", "tile_id"]
    before = (
        p.groupBy(*tile).agg(F.count("*").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("plan_id", "utility").orderBy("tile_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .drop("n")
    )
    p = p.join(before, tile).withColumn("edge_no", F.col("before") + F.row_number().over(W.partitionBy(*tile).orderBy("pipe_id")) - 1)
    ref = reference_pages(tiles)
    return (
        p.join(meta, ["plan_id", "tile_id"], "left")
        .join(ref.withColumn("ref_page", F.lit(True)), ["plan_id", "page_number"], "left")
        .select(
            "plan_id", "utility", "page_number", "tile_id", "pipe_id", "edge_no",
            F.concat_ws(":", "utility", F.concat(F.lit("e"), F.col("edge_no").cast("string")), "tile_id").alias("edge_id"),
            "pipe_type", "size", "material", "length_lf", "slope", "from_station", "to_station", "from_structure_hint", "to_structure_hint", "notes",
            S.distinct_sorted(S.no_nulls(F.col("source_text_ids"), "array<int>")).alias("source_text_ids"),
            F.coalesce("sanitized", F.lit(False)).alias("sanitized"),
            F.coalesce("source_coherence", F.lit(1.0)).alias("source_coherence"),
            (F.coalesce(F.col("sheet_type") == "signing_striping", F.lit(False)) | F.coalesce("ref_page", F.lit(False))).alias("is_reference_only"),
            F.coalesce(S.parse_station(F.col("from_station")), S.parse_station(F.col("from_structure_hint"))).alias("from_ft"),
            F.coalesce(S.parse_station(F.col("to_station")), S.parse_station(F.col("to_structure_hint"))).alias("to_ft"),
        )
    )


def reference_pages(tiles: DataFrame) -> DataFrame:
    """Pages with a signing sheet and no profile."""
    t = F.lower(F.trim("sheet_type"))
    return (
        latest_tiles(tiles).filter(F.coalesce(t, F.lit("")) != "").groupBy("plan_id", "page_number")
        .agg(F.bool_or(t == "signing_striping").alias("signing"), F.bool_or(t == "profile_view").alias("profile"))
        .filter("signing and not profile").select("plan_id", "page_number")
    )


def node_texts(nodes: DataFrame) -> DataFrame:
    """What the matching needs of a node."""
    parts = [F.upper(F.coalesce(F.col(c), F.lit(""))) for c in ("id", "structure_type", "notes")]
    order = F.struct(F.col("page_number").alias("a"), F.coalesce("station_ft", F.lit(FAR)).alias("b"), F.coalesce("offset_ft", F.lit(FAR)).alias("c"), F.col("node_id").alias("d"))
    return nodes.select(*PAGE, "node_id", F.col("station_ft").alias("node_ft"), F.concat_ws(" | ", *parts).alias("blob"), order.alias("node_order"))


def _candidates(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """Requests with each candidate node; pages without nodes fall back to the plan set's nodes."""
    on_page = requests.join(nodes, PAGE)
    bare = requests.join(nodes.select(*PAGE).distinct(), PAGE, "left_anti")
    everywhere = bare.join(nodes.drop("page_number"), ["plan_id", "utility"])
    return on_page.unionByName(everywhere)


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on keys that may be null, as coalesced to values that cannot occur."""
    r = right.select(*[F.col(c).alias(f"_{c}") if c in keys else F.col(c) for c in right.columns])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return left.join(r, on, how).drop(*[f"_{k}" for k in keys])


def best_nodes(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """Best node and confidence of distinct requests ``(page, ft, hint, not_node)``."""
    keys = [*PAGE, "ft", "hint", "not_node"]
    c = _candidates(requests.select(*keys).distinct(), nodes).filter("not_node is null or node_id <> not_node")
    c = c.withColumn("score", S.hint_score(F.col("blob"), F.col("hint"))).withColumn("distance", F.abs(F.col("node_ft") - F.col("ft")))
    rank = F.struct((-F.col("score")).alias("a"), F.coalesce("distance", F.lit(FAR)).alias("b"), F.col("node_id").alias("c"))
    best = c.groupBy(*keys).agg(F.min_by(F.struct("node_id", "score", "distance"), rank).alias("m"))
    return best.select(*keys, F.col("m.node_id").alias("node"), S.match_confidence(F.col("m.distance"), F.col("m.score")).alias("conf"))


def _side(pipes: DataFrame, nodes: DataFrame, side: str, not_node: Column) -> DataFrame:
    hint = F.nullif(F.col(f"{side}_structure_hint"), F.lit(""))
    asked = pipes.withColumns({"ft": F.col(f"{side}_ft"), "hint": hint, "not_node": not_node})
    can = F.col("hint").isNotNull() | F.col("ft").isNotNull()
    got = best_nodes(asked.filter(can), nodes)
    out = _null_safe(asked, got, [*PAGE, "ft", "hint", "not_node"], "left")
    return out.withColumnsRenamed({"node": f"{side}_node", "conf": f"{side}_conf"}).drop("ft", "hint", "not_node")


def _projected(need: DataFrame, nodes: DataFrame) -> DataFrame:
    """Requests with the nodes of their page; on pages without nodes, with those of the plan set within reach of a projected end.

    Only nodes within ``INFER_LOW_FT`` can be taken, so requests and nodes of a plan set meet by stretch, never all with all.
    """
    step = C.INFER_LOW_FT
    on_page = need.join(nodes, PAGE)
    bare = need.join(nodes.select(*PAGE).distinct(), PAGE, "left_anti")
    ends = F.array(F.col("anchor_ft") + F.col("length_lf"), F.col("anchor_ft") - F.col("length_lf"))
    reach = F.flatten(F.transform(ends, lambda x: F.sequence(F.floor((x - step) / step), F.floor((x + step) / step))))
    near = bare.withColumn("stretch", F.explode(F.array_distinct(reach))).join(nodes.drop("page_number").withColumn("stretch", F.floor(F.col("node_ft") / step)), ["plan_id", "utility", "stretch"])
    return on_page.unionByName(near.select(*on_page.columns))


def _inferred(pipes: DataFrame, nodes: DataFrame, missing: str, anchor: str) -> DataFrame:
    """The missing end from the other end's station and the pipe's length: nearest node, first on ties."""
    need = pipes.filter(F.col(f"{missing}_node").isNull() & F.col(f"{anchor}_node").isNotNull() & (F.col("length_lf") > 0))
    at = nodes.select("plan_id", "utility", F.col("node_id").alias("_a"), F.col("node_ft").alias("anchor_ft"))
    need = need.select(*PAGE, "pipe_id", "length_lf", F.col(f"{anchor}_node").alias("anchor")).join(at, (F.col("anchor") == F.col("_a")) & (need.plan_id == at.plan_id) & (need.utility == at.utility)).select(need.plan_id, need.utility, "page_number", "pipe_id", "length_lf", "anchor", "anchor_ft").filter("anchor_ft is not null")
    c = _projected(need, nodes.filter("node_ft is not null")).filter("node_id <> anchor")
    delta = F.least(F.abs(F.col("node_ft") - F.col("anchor_ft") - F.col("length_lf")), F.abs(F.col("node_ft") - F.col("anchor_ft") + F.col("length_lf")))
    best = c.withColumn("delta", delta).groupBy("plan_id", "utility", "pipe_id").agg(F.min_by(F.struct("node_id", "delta"), F.struct("delta", "node_order")).alias("m"))
    return best.filter(F.col("m.delta") <= C.INFER_LOW_FT).select("plan_id", "utility", "pipe_id", F.col("m.node_id").alias("inferred"), S.inferred_confidence(F.col("m.delta")).alias("inferred_conf"))


def matched_pipes(pipes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every pipe with both ends: a node or an orphan anchor, and its confidences."""
    texts = node_texts(nodes)
    m = durable(_side(pipes, texts, "from", F.lit(None).cast("string")))
    m = durable(_side(m, texts, "to", F.col("from_node")))
    for missing, anchor in (("to", "from"), ("from", "to")):
        got = _inferred(m, texts, missing, anchor)
        m = m.join(got, ["plan_id", "utility", "pipe_id"], "left").withColumns(
            {f"{missing}_conf": F.coalesce(f"{missing}_conf", "inferred_conf"), f"{missing}_node": F.coalesce(f"{missing}_node", "inferred")}
        ).drop("inferred", "inferred_conf")
    for side in ("from", "to"):
        m = m.withColumns(
            {
                f"{side}_orphan": F.col(f"{side}_node").isNull(),
                f"{side}_conf": F.coalesce(f"{side}_conf", F.lit("none")),
                f"{side}_node": F.coalesce(f"{side}_node", F.concat_ws(":", F.lit("orphan"), "utility", "edge_id", F.lit(side))),
            }
        )
    return m.withColumn("matched_conf", S.worse(F.col("from_conf"), F.col("to_conf")))
