"""Queries of the general data problems: orphan references, nested records, mixed units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from culvert.functions import units as U
from culvert.operators import nested, orphan_refs, units
from culvert.operators.orphan_refs import NOISE_WORDS
from culvert.sources.tables import table


def _references(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    refs = orphan_refs.plan_set_references(table(spark, sf, "callouts"), table(spark, sf, "structures"))
    targets = orphan_refs.plan_set_targets(table(spark, sf, "sheets"), table(spark, sf, "detail_register"), table(spark, sf, "text_layers"))
    return refs, orphan_refs.missing_keys(refs, targets)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """References whose target was not live when the record was extracted."""
    return orphan_refs.found_rows(*_references(spark, sf))


def p1_counts(spark: SparkSession, sf: str) -> DataFrame:
    """References and orphans per source table, field and month of extraction."""
    return orphan_refs.orphan_counts(*_references(spark, sf), orphan_refs.SOURCE_TABLE)


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    return nested.flatten_records(table(spark, sf, "raw_extractions"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """All nodes of the nested payloads with the path of their parent and their position in it."""
    return _nodes(spark, sf).select("raw_id", "child_kind", "parent_path", "pos")


def p2_structures(spark: SparkSession, sf: str) -> DataFrame:
    return nested.node_table(_nodes(spark, sf), "structure")


def p2_inverts(spark: SparkSession, sf: str) -> DataFrame:
    return nested.node_table(_nodes(spark, sf), "invert")


def p2_text_refs(spark: SparkSession, sf: str) -> DataFrame:
    return nested.node_table(_nodes(spark, sf), "text_ref")


def p2_items(spark: SparkSession, sf: str) -> DataFrame:
    return nested.node_table(_nodes(spark, sf), "item")


def p2_rejected(spark: SparkSession, sf: str) -> DataFrame:
    """Records whose payload cannot be read, with the reason."""
    return nested.rejected_records(table(spark, sf, "raw_extractions"))


def _values(spark: SparkSession, sf: str) -> DataFrame:
    return units.common_values(*[table(spark, sf, t) for t in ("structures", "pipes", "tiles", "units_ref")])


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Values recorded in another unit than the common one, with that unit."""
    return units.other_units(_values(spark, sf))


def p4_values(spark: SparkSession, sf: str) -> DataFrame:
    """Every readable value in the common unit of its quantity."""
    return _values(spark, sf).withColumn("common_value", F.round("common_value", 6))


QUERIES = {f.__name__: f for f in (p1_found, p1_counts, p2_found, p2_structures, p2_inverts, p2_text_refs, p2_items, p2_rejected, p4_found, p4_values)}

_CLEAN = rf"regexp_replace(upper({{x}}), '\b(?:{NOISE_WORDS})\b\.?', ' ; ', 'g')"
_TOKEN = r"regexp_replace(regexp_replace({x}, '[^A-Z0-9]', '', 'g'), '^([A-Z]*)0+([0-9])', '\1\2')"
_TOKENS = "list_transform(regexp_extract_all(" + _CLEAN + r", '(?:^|[^A-Z0-9])([A-Z]{{0,4}}[\s._\-]*[0-9]+[A-Z]?)', 1), lambda z: " + _TOKEN.replace("{x}", "z") + ")"


def _tokens(column: str) -> str:
    return _TOKENS.replace("{x}", column).replace("{{", "{").replace("}}", "}")


_P1 = f"""with c as (select callout_id, plan_id, extracted_at tm, reference_sheet rs, reference_detail rd from callouts where extracted_at is not null),
  s as (select plan_id, cast(page_number as varchar) k, registered_at a, voided_at b from sheets union all select plan_id, {_tokens('sheet_label')}[1], registered_at, voided_at from sheets),
  d as (select {_tokens('detail_code')}[1] k, registered_at a, withdrawn_at b from detail_register),
  rs as (select callout_id id, plan_id, tm, rs raw, unnest({_tokens('rs')}) k from c where rs is not null and plan_id is not null),
  rd as (select callout_id id, tm, rd raw, unnest({_tokens('rd')}) k from c where rd is not null),
  t as (select obs_id id, plan_id, tile_id, extracted_at tm, unnest(source_text_ids) k from structures where extracted_at is not null and plan_id is not null and tile_id is not null),
  l as (select plan_id, tile_id, created_at a, retired_at b, unnest(list_transform(text_items, lambda i: i.text_id)) k from text_layers where text_items is not null),
  f as (select 'reference_sheet' ref_field, id record_id, raw ref_key, tm from rs where not exists (select 1 from s where s.plan_id = rs.plan_id and s.k = rs.k and s.a <= rs.tm and (s.b is null or rs.tm < s.b))
   union all select 'reference_detail', id, raw, tm from rd where not exists (select 1 from d where d.k = rd.k and d.a <= rd.tm and (d.b is null or rd.tm < d.b))
   union all select 'source_text_ids', id, cast(k as varchar), tm from t where k is not null and not exists (select 1 from l where l.plan_id = t.plan_id and l.tile_id = t.tile_id and l.k = t.k and l.a <= t.tm and (l.b is null or t.tm < l.b)))
"""

_P1_COUNTS = _P1 + f""", o as (
    select 'reference_sheet' ref_field, tm, id, unnest(list_distinct({_tokens('rs')})) k, plan_id, null tile_id from (select callout_id id, * from c) where rs is not null and plan_id is not null
   union all select 'reference_detail', tm, id, unnest(list_distinct({_tokens('rd')})), null, null from (select callout_id id, * from c) where rd is not null
   union all select 'source_text_ids', tm, id, cast(k as varchar), plan_id, tile_id from (select distinct id, plan_id, tile_id, tm, k from t) where k is not null),
  j as (select o.*, case o.ref_field
      when 'reference_sheet' then exists (select 1 from s where s.plan_id = o.plan_id and s.k = o.k and s.a <= o.tm and (s.b is null or o.tm < s.b))
      when 'reference_detail' then exists (select 1 from d where d.k = o.k and d.a <= o.tm and (d.b is null or o.tm < d.b))
      else exists (select 1 from l where l.plan_id = o.plan_id and l.tile_id = o.tile_id and cast(l.k as varchar) = o.k and l.a <= o.tm and (l.b is null or o.tm < l.b)) end live from o)
  select case ref_field when 'source_text_ids' then 'structures' else 'callouts' end source_table, ref_field, strftime(tm, '%Y-%m') as month,
    count(*) as "references", cast(sum(case when live then 0 else 1 end) as bigint) orphans from j group by 1, 2, 3"""


def _p4_sql(columns: str, where: str = "") -> str:
    """Values in common units, written from the data statement: first number, first unit word, notes, tile, register."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    lookup = lambda pairs: "map {" + ", ".join(f"{quote(a)}: {quote(b)}" for a, b in pairs) + "}"
    words = lookup((w, c) for c, (*_, ws) in U.LENGTH_UNITS.items() for w in ws)
    slopes = lookup([(w, c) for c, ws in U.SLOPE_WORDS.items() for w in ws] + [("%", "pct"), ("‰", "permil"), ("ft/ft", "frac"), ("m/m", "frac"), ("'/'", "frac"), ("mm/m", "permil"), ("in/ft", "in_per_ft"), ('"/ft', "in_per_ft"), ("in per ft", "in_per_ft")])
    sizes = lookup(U.SIZE_CODE.items())
    plain = lambda c: f"replace(translate(lower({c}), '′’‘´`ʹ″”“ʺ', {quote(6 * chr(39) + 4 * chr(34))}), {quote(2 * chr(39))}, {quote(chr(34))})"
    names = lambda f: "(?:^|[^a-z0-9])" + U.QUANTITY_WORDS[f] + "(?:" + U._LINK + ")+"
    length = lambda n, f: f"{words}[nullif(regexp_extract({n}, {quote(names(f) + '(' + U._LENGTH_WORD + '|inch|inches)(?:[^a-z]|$)')}, 1), '')]"
    slope = lambda n: "case " + " ".join(f"when regexp_matches({n}, {quote(names('slope') + u)}) then {quote(c)}" for c, u in U._SLOPE_NOTE.items()) + " end"
    said = lambda n, f: slope(n) if f == "slope" else length(n, f)
    number = r"replace(regexp_extract(t, '[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?|\.[0-9]+'), ',', '')"
    first = f"try_cast(nullif({number}, '') as double)"
    plus = r"'([0-9]{1,4})\s*\+\s*([0-9]{1,3}(?:\.[0-9]+)?)'"
    station = f"coalesce(try_cast(nullif(regexp_extract(t, {plus}, 1), '') as double) * 100 + try_cast(nullif(regexp_extract(t, {plus}, 2), '') as double), {first})"
    side = "case when regexp_matches(t, '(?:^|[^a-z])(?:left|lt|l)(?:gb)?(?:[^a-z]|$)|lt(?:gb)?(?:[^a-z]|$)') then -1 else 1 end"
    own = f"list_filter(list_transform(regexp_extract_all(t, '[a-z]+|[''\"]'), lambda w: {words}[w]), lambda u: u is not null)[1]"
    part = lambda kind, key, source, f, num, unit, text: f"select '{kind}' record_kind, {key} record_id, '{f}' field_name, plan_id, tile_id, {num} number, {unit} own, {said('n', f)} noted from (select *, {plain(text)} t, {plain('notes')} n from {source})"
    parts = [
        part("structure", "obs_id", "structures", "station", station, own, "station"),
        part("structure", "obs_id", "structures", "offset_txt", f"{side} * {first}", own, "offset_txt"),
        part("pipe", "pipe_id", "pipes", "size", first, own, "size"),
        part("pipe", "pipe_id", "pipes", "slope", "slope", rf"{slopes}[trim(regexp_replace(replace(t, '.', ''), '\s+', ' ', 'g'))]", "slope_unit"),
    ]
    tiled = " union all ".join(f"select plan_id, tile_id, '{f}' field_name, arg_max(u, seen) tiled from (select plan_id, tile_id, ingested_at seen, {said(plain('extraction_notes'), f)} u from tiles) where u is not null group by 1, 2" for f in ("station", "offset_txt", "size", "slope"))
    return f"""with q as ({' union all '.join(parts)}), t as ({tiled}),
      c as (select record_kind, record_id, field_name, number, coalesce(own, noted, tiled) unit from q left join t using (plan_id, tile_id, field_name) where number is not null and not isnan(number)),
      k as (select *, coalesce(case when field_name = 'size' then {sizes}[unit] else unit end, case field_name when 'size' then 'size_inch' when 'slope' then 'frac' else 'ft' end) unit_code from c),
      v as (select k.*, round(case when unit_code = 'one_in_n' then 1 / nullif(number, 0) else number * to_common end, 6) common_value from k left join units_ref using (unit_code))
    select {columns} from v {where}"""


ORACLES = {
    "p1_found": _P1 + "select distinct ref_field, record_id, ref_key from f",
    "p1_counts": _P1_COUNTS,
    "p4_found": _p4_sql("record_kind, record_id, field_name, unit_code", "where unit_code not in ('ft', 'size_inch', 'frac')"),
    "p4_values": _p4_sql("record_kind, record_id, field_name, number, unit_code, common_value"),
}
