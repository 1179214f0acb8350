"""Edges of the utility networks: last write wins, crown filter, reversed duplicates, gravity orientation.

All steps keep one row per ordered node pair.  Edge cases: null lengths and slopes never contradict;
blank texts are filled from the dropped duplicate; ties between duplicates go to the edge that starts at the
earlier node; orphan anchors have no elevation; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from culvert import config as C
from culvert.functions import scalars as S

PAIR = ["plan_id", "utility", "from_node", "to_node"]


def last_write(matched: DataFrame) -> DataFrame:
    """One edge per ordered pair: the attributes of the last pipe, the place of the first."""
    rest = [c for c in matched.columns if c not in (*PAIR, "edge_no")]
    out = matched.groupBy(*PAIR).agg(F.max_by(F.struct(*rest), "edge_no").alias("e"), F.min("edge_no").alias("edge_seq"))
    return out.select(*PAIR, "edge_seq", "e.*").withColumns({"source_tile_ids": F.array("tile_id"), "source_pages": F.array("page_number")}).drop("tile_id", "from_ft", "to_ft")


def crown_nodes(nodes: DataFrame) -> DataFrame:
    """Elevations too far above the lowest invert of a gravity node are set aside as crown readings."""
    e = F.filter(F.transform("inverts", lambda i: i["elevation"]), lambda x: x.isNotNull())
    d = F.filter(F.transform("inverts", lambda i: S.diameter_ft(i["pipe_size"])), lambda x: x.isNotNull())
    spread = F.array_max(d) + C.CROWN_SPREAD_FT
    suspicious = F.col("utility").isin(*C.GRAVITY) & (F.size(e) >= 2) & (F.size(d) >= 1) & (F.array_max(e) - F.array_min(e) > spread)
    limit = F.when(suspicious, F.array_min(e) + spread)
    n = nodes.withColumn("_limit", limit)
    is_crown = lambda i: F.col("_limit").isNotNull() & i["elevation"].isNotNull() & (i["elevation"] > F.col("_limit"))
    n = n.withColumn("crown_suspects", F.filter("inverts", is_crown)).withColumn("inverts", F.filter("inverts", lambda i: ~is_crown(i)))
    return n.withColumn("representative", F.array_min(F.transform("inverts", lambda i: i["elevation"]))).drop("_limit")


def with_ends(edges: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """Adds the named node columns of both ends as ``u_*`` and ``v_*`` (null for orphan anchors)."""
    for end, key in (("u", "from_node"), ("v", "to_node")):
        side = nodes.select("plan_id", "utility", F.col("node_id").alias(key), *[F.col(c).alias(f"{end}_{c}") for c in columns])
        edges = edges.join(side, ["plan_id", "utility", key], "left")
    return edges


def flag_crowns(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Flags gravity edges whose drop is far beyond the labelled one."""
    e = with_ends(edges, nodes, ["representative"])
    expected, actual = F.abs("slope") * F.col("length_lf"), F.abs(F.col("u_representative") - F.col("v_representative"))
    flag = F.col("utility").isin(*C.GRAVITY) & (F.col("length_lf") > 0) & (actual > expected * C.CROWN_DROP_RATIO) & (actual > C.CROWN_MIN_DROP_FT)
    higher = F.when(F.col("u_representative") >= F.col("v_representative"), F.col("from_node")).otherwise(F.col("to_node"))
    flag = F.coalesce(flag, F.lit(False))
    return e.withColumn("crown_candidate", flag).withColumn("suspect_node", F.when(flag, higher)).drop("u_representative", "v_representative")


def _rank() -> Column:
    present = lambda c: (F.coalesce(F.col(c), F.lit("")) != "").cast("int")
    return F.struct(
        S.ordinal(F.col("matched_conf")).alias("a"),
        (S.ordinal(F.col("from_conf")) + S.ordinal(F.col("to_conf"))).alias("b"),
        (present("from_station") + present("to_station")).alias("c"),
        F.length(F.coalesce("notes", F.lit(""))).alias("d"),
        F.size("source_text_ids").alias("e"),
    )


FILLED = ("from_station", "to_station", "from_structure_hint", "to_structure_hint", "notes")


def reversed_duplicates(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """u→v and v→u of the same pipe become one edge with united provenance."""
    order = F.struct(F.col("page_number").alias("a"), F.coalesce("station_ft", F.lit(float("inf"))).alias("b"), F.coalesce("offset_ft", F.lit(float("inf"))).alias("c"), F.col("node_id").alias("d"))
    starts = nodes.select("plan_id", "utility", F.col("node_id").alias("from_node"), order.alias("start"))
    e = edges.join(starts, ["plan_id", "utility", "from_node"], "left").withColumn("rank", _rank())
    facts = ["edge_id", "size", "length_lf", "slope", "rank", "start", "source_tile_ids", "source_pages", "source_text_ids", "sanitized", "crown_candidate", "is_reference_only", *FILLED]
    back = e.select("plan_id", "utility", F.col("to_node").alias("from_node"), F.col("from_node").alias("to_node"), F.struct(*facts).alias("o"))
    j = e.join(back, PAIR, "left")
    far = lambda a, b, tol: F.coalesce(F.abs(a - b) > tol, F.lit(False))
    similar = F.col("o").isNotNull() & (S.norm_size(F.col("size")) == S.norm_size(F.col("o.size"))) & ~far(F.col("length_lf"), F.col("o.length_lf"), C.EDGE_LENGTH_TOL) & ~far(F.col("slope"), F.col("o.slope"), C.EDGE_SLOPE_TOL)
    similar = similar & (F.col("from_node") != F.col("to_node"))
    wins = (F.col("rank") > F.col("o.rank")) | ((F.col("rank") == F.col("o.rank")) & (F.col("start") < F.col("o.start")))
    j = j.withColumn("dup", F.coalesce(similar, F.lit(False))).filter(~F.col("dup") | wins)
    united = {c: F.when(F.col("dup"), F.array_sort(F.array_union(F.col(c), F.col(f"o.{c}")))).otherwise(F.col(c)) for c in ("source_tile_ids", "source_pages", "source_text_ids")}
    either = {c: F.col(c) | (F.col("dup") & F.coalesce(F.col(f"o.{c}"), F.lit(False))) for c in ("sanitized", "crown_candidate", "is_reference_only")}
    filled = {c: F.when(F.col("dup") & (F.coalesce(F.col(c), F.lit("")) == "") & (F.coalesce(F.col(f"o.{c}"), F.lit("")) != ""), F.col(f"o.{c}")).otherwise(F.col(c)) for c in FILLED}
    return j.withColumns({**united, **either, **filled}).drop("o", "dup", "rank", "start")


def orient_by_gravity(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Gravity edges run from the higher to the lower invert; a turned edge replaces one that is already there."""
    e = with_ends(edges, nodes, ["representative"])
    turn = F.coalesce(F.col("utility").isin(*C.GRAVITY) & (F.col("u_representative") < F.col("v_representative") - C.INVERT_TOL), F.lit(False))
    swaps = [("from_node", "to_node"), ("from_station", "to_station"), ("from_structure_hint", "to_structure_hint"), ("from_conf", "to_conf"), ("from_orphan", "to_orphan")]
    new = {}
    for a, b in swaps:
        new[a], new[b] = F.when(F.col("_turn"), F.col(b)).otherwise(F.col(a)), F.when(F.col("_turn"), F.col(a)).otherwise(F.col(b))
    new["original_from_node"], new["original_to_node"] = F.when(F.col("_turn"), F.col("from_node")), F.when(F.col("_turn"), F.col("to_node"))
    t = e.withColumn("_turn", turn).drop("u_representative", "v_representative").withColumns(new).withColumnRenamed("_turn", "oriented_by_gravity")
    rest = [c for c in t.columns if c not in PAIR and c != "crown_candidate"]
    # a crown flag of the replaced edge stays
    out = t.groupBy(*PAIR).agg(F.max_by(F.struct(*rest), F.col("oriented_by_gravity").cast("int")).alias("e"), F.bool_or("crown_candidate").alias("crown_candidate"))
    return out.select(*PAIR, "crown_candidate", "e.*")
