"""Queries of the problems tagged llm, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from culvert.llm import canonical_values, exact_copies, garbled, linkage, mixing, survivors, tokens
from culvert.sources.tables import table


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical code, or ``none``, of every free-entered value that is not itself a code."""
    values = canonical_values.typed_values(table(spark, sf, "structures"), table(spark, sf, "callouts"), table(spark, sf, "pipes"))
    return canonical_values.map_values(values, table(spark, sf, "canon_values"))


def p3_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """Values without an entry, with their number of rows per kind."""
    values = canonical_values.typed_values(table(spark, sf, "structures"), table(spark, sf, "callouts"), table(spark, sf, "pipes"))
    codes = canonical_values.map_values(values, table(spark, sf, "canon_values"), keep_value=True).filter("canon_code = 'none'")
    return codes.groupBy("record_kind", "value").agg(F.count("*").alias("n"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """The row that supplies the surviving value of each field of each node merged more than once."""
    picked = survivors.ranked_survivors(table(spark, sf, "merged_structures"), ["plan_id", "node_id"], survivors.node_fields(), survivors.trust_order(), "merged_id")
    return picked.select("plan_id", "node_id", "field_name", "merged_id")


def p5_survivors(spark: SparkSession, sf: str) -> DataFrame:
    """One surviving record per node merged more than once."""
    records = survivors.surviving_records(table(spark, sf, "merged_structures"), ["plan_id", "node_id"], survivors.record_fields(), survivors.trust_order())
    lowest = F.round(F.array_min(F.transform("inverts", lambda i: i["elevation"])), 6)
    return records.withColumn("inverts_count", F.coalesce(F.size("inverts"), F.lit(0))).withColumn("lowest_invert", lowest).drop("inverts")


def p5_truth(spark: SparkSession, sf: str) -> DataFrame:
    """The same fields decided by iterative truth discovery instead of a stated precedence."""
    return survivors.discover_truth(survivors.node_claims(table(spark, sf, "merged_structures")), ["plan_id", "node_id"])


def _keyed(spark: SparkSession, sf: str) -> DataFrame:
    return exact_copies.plan_set_records(table(spark, sf, "structures"), table(spark, sf, "pipes"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Copies of records that differ in formatting only, each with the smallest id of its group."""
    return exact_copies.copies(_keyed(spark, sf)).withColumnRenamed("kind", "record_kind")


def p6_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """One record each with its number of copies."""
    return exact_copies.collapse(_keyed(spark, sf)).withColumnRenamed("kind", "record_kind")


def p7_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links of structure observations and surveyed assets with their confidence."""
    return linkage.plan_set_links(*[table(spark, sf, t) for t in ("structures", "tiles", "surveyed_assets", "canon_values", "units_ref")])


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of an observation and an asset that are the same real thing."""
    return p7_links(spark, sf).select("obs_id", "asset_id")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode(table(spark, sf, "documents"))


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The chosen documents with their repeats."""
    return mixing.choose(mixing.sized_documents(table(spark, sf, "documents")), table(spark, sf, "mix_targets"))


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and actual shares of the mix."""
    return mixing.shares(p9_mix(spark, sf), table(spark, sf, "mix_targets"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that were decoded, wholly or in part, with a wrong encoding."""
    return garbled.repair(table(spark, sf, "documents")).select("doc_id")


def p10_restored(spark: SparkSession, sf: str) -> DataFrame:
    """Affected documents with their restored text."""
    return garbled.repair(table(spark, sf, "documents"))


QUERIES = {
    f.__name__: f
    for f in (p3_found, p3_unmatched, p5_found, p5_survivors, p5_truth, p6_found, p6_distinct, p7_found, p7_links, p8_ids, p9_mix, p9_shares, p10_found, p10_restored)
}

_NOTHING = ",".join(f"'{w}'" for w in survivors.NOTHING_KNOWN)


def _says(column: str) -> str:
    bare = f"regexp_replace(lower({column}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
    return f"{column} is not null and {bare} <> '' and {bare} not in ({_NOTHING})"


_HAS = {
    "rim_elevation": "rim_elevation is not null and len(list_filter(rim_elevation_values, lambda v: round(v*100) = round(rim_elevation*100))) > 0",
    "size": _says("size"),
    "notes": _says("notes"),
}
_P5 = "with r as (select *, count(*) over (partition by plan_id, node_id) n, row_number() over (partition by plan_id, node_id order by case when sanitized = false then 0 else 1 end, variants_count desc nulls last, merged_at desc nulls last, merged_id) o from merged_structures where plan_id is not null and node_id is not null) " + " union all ".join(
    f"select plan_id, node_id, '{f}' field_name, arg_min(merged_id, o) merged_id from r where n >= 2 and {has} group by 1, 2" for f, has in _HAS.items()
)


def _parts(column: str) -> str:
    t = f"lower(translate({column}, '∅⌀', 'øø'))"
    for marks, plain in (("′’‘´`ʹ＇", "''"), ("″”“ʺ＂", '"')):
        t = f"regexp_replace({t}, '[{marks}]', '{plain}', 'g')"
    t = f"regexp_replace({t}, '''\\s*''', '\"', 'g')"
    t = f"regexp_replace({t}, '([0-9]),([0-9][0-9][0-9])([^0-9]|$)', '\\1\\2\\3', 'g')"
    # every number with its mark, every word; the two are listed apart, each in its own order
    number = "[0-9]+/[0-9]+|[0-9]+[.][0-9]+|[0-9]+|[.][0-9]+"
    loose = f"(len(regexp_extract_all({t}, '[0-9]+([.][0-9]+)?')) = 1 and len(regexp_extract_all({t}, '[''\"]')) = 1)"
    numbers = f"case when {loose} then [regexp_extract({t}, '{number}') || regexp_extract({t}, '[''\"]')] else list_transform(regexp_extract_all({t}, '({number})[\\s ]*[''\"]|{number}|[''\"]'), lambda p: regexp_replace(p, '[\\s ]', '', 'g')) end"
    words = f"list_transform(regexp_extract_all({t}, '(\\p{{L}}[.])+\\p{{L}}\\b|\\p{{L}}+'), lambda p: regexp_replace(p, '[.\\s]+', '', 'g'))"
    return f"case when {column} is not null then array_to_string(list_sort({numbers}), ' ') || '|' || array_to_string(list_sort({words}), ' ') end"


def _copies_of(kind: str, table_name: str, key: str, loose: list[str]) -> str:
    changed = ", ".join(f"{_parts(c)} as {c}" for c in loose)
    keyed = f"select id, cast(to_json(t) as varchar) k from (select {key} as id, * exclude ({key}, ingested_at) replace ({changed}) from {table_name}) t"
    stripped = f"select id, regexp_replace(k, '^.\"id\":[0-9]+,', '') k from ({keyed})"
    return f"select '{kind}' record_kind, first_id, id copy_id from (select id, min(id) over (partition by k) first_id from ({stripped})) where id <> first_id"


_SURVIVORS = (
    _P5[: _P5.index(" select plan_id, node_id, 'rim_elevation'")]
    + " select plan_id, node_id, count(*) records, "
    + ", ".join(f"arg_min({f}, o) filter ({_says(f)}) {f}" for f in survivors.TEXT_FIELDS)
    + ", "
    + ", ".join(f"arg_min({f}, o) filter ({f} is not null) {f}" for f in (*survivors.NUMBER_FIELDS, "is_existing", "page_number"))
    + f", arg_min(rim_elevation, o) filter ({_HAS['rim_elevation']}) rim_elevation"
    + ", cast(coalesce(len(arg_min(inverts, o) filter (len(inverts) > 0)), 0) as integer) inverts_count"
    + ", round(list_min(list_transform(arg_min(inverts, o) filter (len(inverts) > 0), lambda i: i.elevation)), 6) lowest_invert"
    + " from r where n >= 2 group by 1, 2"
)


def _groups_of(kind: str, table_name: str, key: str, loose: list[str]) -> str:
    return _copies_of(kind, table_name, key, loose).replace("first_id, id copy_id from", "first_id, count(*) copies from").replace(" where id <> first_id", " group by first_id")


ORACLES = {
    "p5_survivors": _SURVIVORS,
    "p6_distinct": _groups_of("structure", "structures", "obs_id", ["offset_txt"]) + " union all " + _groups_of("pipe", "pipes", "pipe_id", ["size", "material"]),
    "p5_found": _P5,
    "p6_found": _copies_of("structure", "structures", "obs_id", ["offset_txt"]) + " union all " + _copies_of("pipe", "pipes", "pipe_id", ["size", "material"]),
}
