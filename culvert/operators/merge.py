"""Structure observations merged into one node per real structure and utility.

Step 1 groups by page, type and parsed position (or by the normalised texts where a position cannot
be parsed) and keeps the fullest record, with provenance of all.  Step 2 merges neighbours along
the line: leaders are taken in order of station; an observation joins the first leader within the
tolerances, which are measured from the leader, so merging is not transitive.

Scale: step 1 is one partially aggregated shuffle.  For step 2 a group is first cut wherever
neighbouring stations are further apart than the tolerance, since no leader reaches across such a gap; only
the short runs between gaps are folded, natively.

Edge cases: null arrays are empty and null elements are dropped; null stations form no neighbourhood; null
offsets lie on the centre line; a zero offset has no side; repeated rows count as variants; ties
go to the earlier tile and then the smaller observation id; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from culvert import config as C
from culvert.functions import scalars as S

INVERT = "struct<direction:string,pipe_size:string,pipe_type:string,elevation:double,source_text_ids:array<int>>"
STRUCTURE_COLUMNS = [
    "obs_id", "plan_id", "tile_id", "page_number", "id", "structure_type", "size", "station", "offset_txt", "rim_elevation", "tc_elevation", "fl_elevation", "inverts", "is_existing", "notes", "source_text_ids",
]
PLACE = ["plan_id", "utility", "page_number", "kind"]


def latest_tiles(tiles: DataFrame) -> DataFrame:
    """One row per tile: the last delivery."""
    order = F.struct(F.coalesce("ingested_at", F.lit(0).cast("timestamp").cast(tiles.schema["ingested_at"].dataType)).alias("a"), F.coalesce("extracted_at", F.lit(0).cast("timestamp").cast(tiles.schema["extracted_at"].dataType)).alias("b"), F.xxhash64(*[c for c in ("status", "sanitized", "coherence_score", "sheet_type")]).alias("c"))
    cols = [c for c in tiles.columns if c not in ("plan_id", "tile_id")]
    return tiles.dropna(subset=["plan_id", "tile_id"]).groupBy("plan_id", "tile_id").agg(F.max_by(F.struct(*cols), order).alias("t")).select("plan_id", "tile_id", "t.*")


def matches_utility(kind: Column, utility: Column, has_inverts: Column) -> Column:
    """Substring test, membership of the utility's types, or a grade break with inverts."""
    member = F.lit(False)
    for u, types in C.UTILITY_TYPES.items():
        member = member | ((utility == u) & kind.isin(*types))
    return (kind != "") & (F.contains(kind, utility) | member | ((kind == "GB") & has_inverts))


def utility_observations(structures: DataFrame, tiles: DataFrame) -> DataFrame:
    """Observations of every utility they belong to, with parsed position, rank and tile state."""
    meta = latest_tiles(tiles).select("plan_id", "tile_id", F.coalesce("sanitized", F.lit(False)).alias("sanitized"), "coherence_score")
    inverts = S.no_nulls(F.col("inverts"), f"array<{INVERT}>")
    # only the columns of the operator, so that other columns cannot clash
    s = structures.select(*STRUCTURE_COLUMNS).filter("plan_id is not null and page_number is not null").withColumns(
        {
            "inverts": inverts,
            "source_text_ids": S.no_nulls(F.col("source_text_ids"), "array<int>"),
            "kind": S.norm_token(F.col("structure_type")),
        }
    )
    s = s.withColumn("utility", F.explode(F.array(*[F.lit(u) for u in C.UTILITIES]))).filter(matches_utility(F.col("kind"), F.col("utility"), F.size("inverts") > 0))
    s = s.withColumns(
        {
            "station_ft": S.parse_station(F.col("station")),
            "offset_text": S.offset_or_center(F.col("offset_txt")),
            "offset_ft": S.effective_offset(F.col("offset_txt")),
        }
    )
    located = F.col("station_ft").isNotNull() & F.col("offset_ft").isNotNull()
    return s.join(meta, ["plan_id", "tile_id"], "left").withColumns(
        {
            "sanitized": F.coalesce("sanitized", F.lit(False)),
            "key": F.when(located, F.concat_ws("@", F.round("station_ft", 2).cast("string"), F.round(F.col("offset_ft"), 2).cast("string"))).otherwise(
                F.concat_ws("/", F.lit("text"), S.norm_token(F.col("station")), S.norm_token(F.col("offset_text")))
            ),
            "n_inverts": F.size("inverts"),
            "n_notes": F.length(F.trim(F.coalesce("notes", F.lit("")))),
            "n_ids": F.size("source_text_ids"),
        }
    )


def _first_value(column: str, rank: Column) -> Column:
    """Value of the best ranked row that has one."""
    return F.min_by(column, F.when(F.col(column).isNotNull(), rank)).alias(column)


def exact_merge(obs: DataFrame) -> DataFrame:
    """One row per utility, page, type and exact position."""
    rank = F.struct((-F.col("n_inverts")).alias("a"), (-F.col("n_notes")).alias("b"), (-F.col("n_ids")).alias("c"), F.col("tile_id").alias("d"), F.col("obs_id").alias("e"))
    longest = F.struct((-F.col("n_notes")).alias("a"), F.col("tile_id").alias("b"), F.col("obs_id").alias("c"))
    best = F.struct("structure_type", "station", "offset_text", "station_ft", "offset_ft", "inverts")
    ids = F.concat(F.col("source_text_ids"), F.flatten(F.transform(F.col("inverts"), lambda i: S.no_nulls(i["source_text_ids"], "array<int>"))))
    grouped = obs.withColumn("ids", ids).groupBy(*PLACE, "key").agg(
        F.min_by(best, rank).alias("best"),
        *[_first_value(c, rank) for c in ("id", "size", "rim_elevation", "tc_elevation", "fl_elevation")],
        F.bool_or(F.coalesce("is_existing", F.lit(False))).alias("is_existing"),
        F.min_by(F.struct("notes"), longest).alias("n"),
        S.distinct_sorted(F.collect_set("tile_id")).alias("source_tile_ids"),
        S.distinct_sorted(F.flatten(F.collect_set("ids"))).alias("source_text_ids"),
        F.bool_or("sanitized").alias("sanitized"),
        F.min("coherence_score").alias("min_coherence"),
        F.count("*").alias("variants_count"),
        F.array_sort(F.array_distinct(F.transform(F.collect_set(F.when(~F.isnan("rim_elevation"), F.col("rim_elevation"))), lambda v: F.round(v, 4)))).alias("rim_values"),
        F.min(F.struct("tile_id", "obs_id")).alias("first_seen"),
    )
    return grouped.select(
        *PLACE, "key", "best.structure_type", "best.station", F.col("best.offset_text").alias("offset"), "best.station_ft", "best.offset_ft", "best.inverts", "id", "size",
        "rim_elevation", "tc_elevation", "fl_elevation", "is_existing", F.col("n.notes").alias("notes"), "source_tile_ids", "source_text_ids", "sanitized", "min_coherence", "variants_count", "rim_values", "first_seen",
    )


def leaders(merged: DataFrame) -> DataFrame:
    """Adds ``leader``: rows of a place with the same leader form one node; ``seat`` is the order within it."""
    order = W.partitionBy(*PLACE).orderBy(F.col("station_ft").asc_nulls_last(), "first_seen")
    gap = F.col("station_ft") - F.lag("station_ft").over(order)
    starts = F.when(F.col("station_ft").isNull() | gap.isNull() | (gap > C.MERGE_STATION_FT), 1).otherwise(0)
    seated = merged.withColumn("seat", F.row_number().over(order)).withColumn("starts", starts).withColumn("run", F.sum("starts").over(order.rowsBetween(W.unboundedPreceding, 0)))
    rest = [c for c in merged.columns if c not in PLACE]
    item = F.struct("seat", F.struct(*rest).alias("row"))
    state = "array<struct<seat:int,st:double,off:double,of:int>>"

    def fold(acc: Column, x: Column) -> Column:
        # leaders are the members that lead themselves; the first that accepts takes the item
        accepts = F.filter(
            acc,
            lambda a: (a["of"] == a["seat"])
            & (F.abs(a["st"] - x["st"]) <= C.MERGE_STATION_FT)
            & (a["off"].isNull() | x["off"].isNull() | (F.abs(a["off"] - x["off"]) <= C.MERGE_OFFSET_FT)),
        )
        of = F.coalesce(F.get(F.transform(accepts, lambda a: a["seat"]), F.lit(0)), x["seat"])
        return F.concat(acc, F.array(F.struct(x["seat"].alias("seat"), x["st"].alias("st"), x["off"].alias("off"), of.alias("of"))))

    # a run is short, so its rows travel with it and need no join afterwards
    runs = seated.groupBy(*PLACE, "run").agg(F.array_sort(F.collect_list(item)).alias("items"))
    places = F.transform("items", lambda i: F.struct(i["seat"].alias("seat"), i["row"]["station_ft"].alias("st"), i["row"]["offset_ft"].alias("off")))
    led = runs.withColumn("led", F.aggregate(places, F.array().cast(state), fold))
    one = led.select(*PLACE, F.explode(F.arrays_zip("items", "led")).alias("z"))
    return one.select(*PLACE, F.col("z.items.seat").alias("seat"), F.col("z.led.of").alias("leader"), "z.items.row.*")


def collapse(led: DataFrame) -> DataFrame:
    """One node per leader: fullest member, first values in rank order, united provenance."""
    rank = F.struct((-F.size("inverts")).alias("a"), (-F.length(F.trim(F.coalesce("notes", F.lit(""))))).alias("b"), (-F.size("source_text_ids")).alias("c"), F.col("seat").alias("d"))
    longest = F.struct((-F.length(F.trim(F.coalesce("notes", F.lit(""))))).alias("a"), F.col("seat").alias("b"))
    best = F.struct("structure_type", "station", "offset", "station_ft", "offset_ft", "inverts", "id", "size")
    nodes = led.groupBy(*PLACE, "leader").agg(
        F.min_by(best, rank).alias("best"),
        *[_first_value(c, rank) for c in ("rim_elevation", "tc_elevation", "fl_elevation")],
        F.min_by("id", F.when(F.col("id").isNotNull(), rank)).alias("any_id"),
        F.min_by("size", F.when(F.col("size").isNotNull(), rank)).alias("any_size"),
        F.bool_or("is_existing").alias("is_existing"),
        F.min_by(F.struct("notes"), longest).alias("n"),
        S.distinct_sorted(F.flatten(F.collect_list("source_tile_ids"))).alias("source_tile_ids"),
        S.distinct_sorted(F.flatten(F.collect_list("source_text_ids"))).alias("source_text_ids"),
        F.bool_or("sanitized").alias("sanitized"),
        F.coalesce(F.min("min_coherence"), F.lit(1.0)).alias("min_coherence"),
        F.sum("variants_count").alias("variants_count"),
        S.distinct_sorted(F.flatten(F.collect_list("rim_values"))).alias("rim_values"),
    )
    blank = lambda c: F.nullif(c, F.lit(""))
    nodes = nodes.select(
        "plan_id", "utility", "page_number", "kind", "best.structure_type", "best.station", "best.offset", "best.station_ft", "best.offset_ft", "best.inverts",
        F.coalesce(blank(F.col("best.id")), "any_id").alias("id"), F.coalesce(blank(F.col("best.size")), "any_size").alias("size"),
        "rim_elevation", "tc_elevation", "fl_elevation", "is_existing", F.col("n.notes").alias("notes"), "source_tile_ids", "source_text_ids", "sanitized", "min_coherence", "variants_count", "rim_values",
    )
    return nodes.withColumns(
        {
            "node_id": S.node_id(F.col("utility"), F.col("page_number"), F.col("structure_type"), F.col("station"), F.col("offset"), F.col("station_ft"), F.col("offset_ft")),
            "representative": F.array_min(F.transform("inverts", lambda i: i["elevation"])),
        }
    )


def merged_nodes(structures: DataFrame, tiles: DataFrame) -> DataFrame:
    """Structure nodes of all plan sets and utilities, with the least coherence of their tiles (1.0 where none is known)."""
    return collapse(leaders(exact_merge(utility_observations(structures, tiles))))
