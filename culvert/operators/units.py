"""Quantities recorded in different units, converted to the common unit of their quantity.

The unit stands with the value, else in the record's notes, else in the extraction notes of its
tile, else it is the common unit.  Numbers and units are read once per record, before the one join with the
tiles, of which only those whose notes state a unit take part, reduced to one row per tile.
Factors come from the register of units (bounded by ``MAX_UNITS``).

Edge cases: null and unreadable values give no row; a null slope gives no row; a slope of 1 in 0 has no
value; where no unit is known and the value is followed by an unknown word, or a slope has an
unknown or not dimensionless unit, unit and common value are null, and the row is kept; a
dimensionless unit without a code is converted with a null code; a tile delivered several times states the
unit of the last delivery that states one; empty tables give no rows; no row is dropped for a
missing tile; without a register the factors of the lexicon hold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from culvert.functions import units as U
from culvert.runtime import collect_bounded

COMMON = {"station": "ft", "offset_txt": "ft", "size": "size_inch", "slope": "frac"}
MAX_UNITS = 1_000


def _part(field: str, number: str, own: str, own_scale: str, unknown: str) -> str:
    return f"named_struct('field_name', '{field}', 'number', cast({number} as double), 'own', {own}, 'own_scale', cast({own_scale} as double), 'unknown', {unknown})"


def _length_part(field: str, number: str, plain: str) -> str:
    return U.let(U.length_unit_sql(plain), "o", _part(field, number, "o", "null", f"case when o is null then {U.unknown_unit_sql(plain)} end"))


def position_parts(station: str, offset: str) -> Column:
    """Array of the two values of a position, read from columns whose marks are plain."""
    return F.expr(f"array({_length_part('station', U.station_sql(station), station)}, {_length_part('offset_txt', U.signed_sql(offset), offset)})")


def recorded_quantities(structures: DataFrame, pipes: DataFrame) -> DataFrame:
    """One row per record with the array ``q`` of its values: number, the unit that stands with it and the one its notes state."""
    keep = ["plan_id", "tile_id", "notes"]
    s = structures.select(F.lit("structure").alias("record_kind"), F.col("obs_id").alias("record_id"), *keep, U.plain_marks(F.col("station")).alias("_s"), U.plain_marks(F.col("offset_txt")).alias("_o"))
    s = s.withColumn("q", position_parts("_s", "_o"))
    p = pipes.select(F.lit("pipe").alias("record_kind"), F.col("pipe_id").alias("record_id"), *keep, U.plain_marks(F.col("size")).alias("_z"), "slope", "slope_unit", F.when(F.trim("slope_unit") != "", U.slope_unit_of("slope_unit")).alias("_u"))
    unread = "case when _u is null and trim(slope_unit) <> '' then slope_unit end"
    p = p.withColumn("q", F.expr(f"array({_length_part('size', U.number_sql('_z'), '_z')}, {_part('slope', 'slope', '_u.code', '_u.scale', unread)})"))
    columns = ["record_kind", "record_id", "plan_id", "tile_id", "q"]
    return s.select(*columns, noted_units(F.col("notes"), "station", "offset_txt").alias("noted")).unionByName(p.select(*columns, noted_units(F.col("notes"), "size", "slope").alias("noted")))


def noted_units(notes: Column, *fields: str) -> Column:
    """Struct of the units a note states, one field per quantity; only ``fields`` are looked for.  Null where there is no note."""
    return F.when(notes.isNotNull(), F.struct(*[(U.note_unit(notes, f) if f in fields else F.lit(None).cast("string")).alias(f) for f in COMMON]))


def tile_units(tiles: DataFrame) -> DataFrame:
    """``(t_plan, t_tile, tiled)``: the units stated by the extraction notes of a tile, one row per tile that states any."""
    stated = tiles.filter("extraction_notes is not null and plan_id is not null and tile_id is not null").select(
        F.col("plan_id").alias("t_plan"), F.col("tile_id").alias("t_tile"), F.struct("ingested_at", "extracted_at").alias("t_at"), noted_units(F.col("extraction_notes"), *COMMON).alias("u")
    )
    last = [F.max_by(f"u.{f}", F.when(F.col(f"u.{f}").isNotNull(), F.struct("t_at", F.col(f"u.{f}").alias("v")))).alias(f) for f in COMMON]
    return stated.filter(" or ".join(f"u.{f} is not null" for f in COMMON)).groupBy("t_plan", "t_tile").agg(*last).select("t_plan", "t_tile", F.struct(*COMMON).alias("tiled"))


def factors(units_ref: DataFrame | None) -> dict[str, float]:
    """Factor to the common unit of every unit code; one without a factor is not converted by a product."""
    out = {code: scale for code, (_, scale, _, _) in U.LENGTH_UNITS.items()}
    out |= {size: out[code] * 12.0 for code, size in U.SIZE_CODE.items()} | U.SLOPE_SCALE
    if units_ref is not None:
        rows = collect_bounded(units_ref.filter("unit_code is not null and to_common is not null").select("unit_code", "to_common"), MAX_UNITS, "units")
        out |= {r["unit_code"]: float(r["to_common"]) for r in rows}
    return out


def unit_and_value(scale_of: dict[str, float]) -> str:
    """SQL of ``struct(unit_code, common_value)`` of the value ``q``, given the units ``noted`` and ``tiled`` that its notes and its tile state."""
    said = ", ".join(f"case when q.field_name = '{f}' then coalesce(noted.{f}, tiled.{f}) end" for f in COMMON)
    unit = f"case when q.own is not null or q.own_scale is not null then q.own else coalesce({said}) end"
    factors_, sizes = U._map_sql(tuple(scale_of.items())), U._map_sql(tuple(U.SIZE_CODE.items()))
    shifts = U._map_sql(tuple((c, o) for c, (_, _, o, _) in U.LENGTH_UNITS.items()))
    common = "case q.field_name " + " ".join(f"when '{f}' then '{c}'" for f, c in COMMON.items()) + " end"
    code = f"coalesce(case when q.field_name = 'size' then {sizes}[u] end, u, case when q.own_scale is null and q.unknown is null then {common} end)"
    # a length unit without a code for pipe sizes goes by feet
    lengths = ", ".join(f"'{c}'" for c in U.LENGTH_UNITS)
    scale = f"case when q.field_name = 'size' and c in ({lengths}) then {factors_}[c] * 12 when c is null then q.own_scale else {factors_}[c] end"
    value = f"case when c = 'one_in_n' then 1D / nullif(q.number, 0D) else q.number * {scale} + coalesce({shifts}[c], 0D) end"
    return U.let(unit, "u", U.let(code, "c", f"named_struct('unit_code', c, 'common_value', {value})"))


def common_values(structures: DataFrame, pipes: DataFrame, tiles: DataFrame, units_ref: DataFrame | None = None) -> DataFrame:
    """``(record_kind, record_id, field_name, number, unit_code, common_value)`` of every readable value."""
    records = recorded_quantities(structures, pipes)
    keyed = "plan_id is not null and tile_id is not null"
    t = tile_units(tiles)
    # records without a tile are kept out of the join, where they would meet in one task
    joined = records.filter(keyed).join(t, (F.col("plan_id") == F.col("t_plan")) & (F.col("tile_id") == F.col("t_tile")), "left").drop("t_plan", "t_tile")
    every = joined.unionByName(records.filter(f"not ({keyed})").withColumn("tiled", F.lit(None).cast(t.schema["tiled"].dataType)))
    each = every.select("record_kind", "record_id", "noted", "tiled", F.explode("q").alias("q")).filter("q.number is not null and not isnan(q.number)")
    value = F.expr(unit_and_value(factors(units_ref)))
    return each.select("record_kind", "record_id", F.col("q.field_name").alias("field_name"), F.col("q.number").alias("number"), value.alias("v")).select("record_kind", "record_id", "field_name", "number", "v.*")


def other_units(values: DataFrame) -> DataFrame:
    """Values recorded in another unit than the common one; those of unknown units are not among them."""
    return values.filter(~F.col("unit_code").isin(*set(COMMON.values()))).select("record_kind", "record_id", "field_name", "unit_code")
