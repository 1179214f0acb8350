"""References to records that do not exist, with validity periods on the target side.

A *reference* is a row ``(ref_field, scope, block, mask, at, n)``: the field it comes from, the
scope its key is unique in (a plan set, a tile, or ''), a key block, the keys wanted inside
the block as bits of a 64-bit mask, the instant at which the target has to be live, and how
many recorded references the row stands for.  Textual keys use ``block`` = the key itself and
mask 1.  Dense integer keys use 64 keys per block, so a text layer of 60 spans is one or
two target rows instead of 60.

A *target* is ``(ref_field, scope, block, mask, start_at, end_at)``; it is live from
``start_at`` until before ``end_at`` (null: open).

Skew: references are pre-aggregated per key and instant before any shuffle.  Keys holding
at least ``heavy_share`` of all references are found exactly; there can be no more than
``1 / heavy_share`` of them.  Their targets are counted: below ``broadcast_rows`` they are
broadcast, so the join does not move the heavy references (what is live is then put together by key and
instant); above it the heavy references are salted and their targets replicated once per salt.  All other keys take part in one shuffle
anti-join.  The two orphan sets are disjoint by key and are united.

Defined edge cases: null keys and null references are no references; a null ``at`` is not
judged (no result row); a null start or an empty period is never live; repeated rows count
once in the found rows and as often as recorded in the counts; empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from culvert.runtime import collect_bounded

KEY = ["ref_field", "scope", "block"]


def mask_of(ids: Column, block: Column) -> Column:
    """Bits of the integers of array ``ids`` that lie in 64-key ``block``."""
    return F.aggregate(
        ids,
        F.lit(0).cast("bigint"),
        lambda acc, i: F.when(F.shiftright(i, 6) == block, acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i.bitwiseAND(F.lit(63))))).otherwise(acc),
    )


def blocks_of(ids: Column) -> Column:
    """Distinct 64-key blocks of an integer array, nulls dropped."""
    return F.array_distinct(F.transform(F.filter(ids, lambda i: i.isNotNull()), lambda i: F.shiftright(i, 6)))


def heavy_keys(refs: DataFrame, heavy_share: float) -> list:
    """Keys holding at least ``heavy_share`` of all references: exact, at most ``1 / heavy_share`` rows."""
    per_key = refs.groupBy(*KEY).agg(F.sum("n").alias("n"))
    total = per_key.agg(F.sum("n")).collect()[0][0] or 0
    if not total:
        return []
    floor = max(2, ceil(total * heavy_share))
    return collect_bounded(per_key.filter(F.col("n") >= floor).select(*KEY), int(1 / heavy_share) + 1, "heavy keys")


def _is_heavy(keys: list) -> Column:
    if not keys:
        return F.lit(False)
    return F.struct(*KEY).isin([F.struct(*[F.lit(k[c]) for c in KEY]) for k in keys])


def _missing(refs: DataFrame, targets: DataFrame, extra: list[str], hint: str | None = None) -> DataFrame:
    """Anti-join by bits: the wanted keys of each (key, instant) that no live target holds."""
    right = targets.select(*[F.col(c).alias(f"t_{c}") for c in KEY + extra], F.col("mask").alias("t_mask"), "start_at", "end_at")
    if hint:
        right = right.hint(hint)
    on = [F.col(c) == F.col(f"t_{c}") for c in KEY + extra]
    on += [F.col("start_at") <= F.col("at"), F.col("end_at").isNull() | (F.col("at") < F.col("end_at"))]
    joined = refs.join(right, reduce(lambda a, b: a & b, on), "left")
    grouped = joined.groupBy(*KEY, "at").agg(F.first("mask").alias("mask"), F.first("n").alias("n"), F.bit_or("t_mask").alias("live"))
    missing = F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce(F.col("live"), F.lit(0).cast("bigint"))))
    return grouped.select(*KEY, "at", missing.alias("missing"), "n").filter("missing <> 0")


def missing_keys(
    refs: DataFrame,
    targets: DataFrame,
    *,
    heavy_share: float = 1 / 48,
    broadcast_rows: int = 200_000,
    salts: int = 64,
) -> DataFrame:
    """``(ref_field, scope, block, at, missing)``: keys that no live target holds at that instant."""
    refs = refs.filter("ref_field is not null and scope is not null and block is not null and at is not null and mask <> 0")
    targets = targets.filter("start_at is not null and (end_at is null or start_at < end_at)")
    wanted = refs.groupBy(*KEY, "at").agg(F.bit_or("mask").alias("mask"), F.sum("n").alias("n"))
    # one live period per key, mask and start is enough: the longest
    held = targets.groupBy(*KEY, "mask", "start_at").agg(
        F.when(F.bool_or(F.col("end_at").isNull()), None).otherwise(F.max("end_at")).alias("end_at")
    )
    keys = heavy_keys(wanted, heavy_share)
    light = _missing(wanted.filter(~_is_heavy(keys)), held.filter(~_is_heavy(keys)), [])
    if not keys:
        return light.drop("n")
    hot, hot_held = wanted.filter(_is_heavy(keys)), held.filter(_is_heavy(keys))
    if hot_held.limit(broadcast_rows + 1).count() <= broadcast_rows:
        heavy = _missing(hot, hot_held, [], "broadcast")
    else:
        hot = hot.withColumn("salt", F.pmod(F.xxhash64("at"), F.lit(salts)).cast("int"))
        hot_held = hot_held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        heavy = _missing(hot, hot_held, ["salt"], "merge")
    return light.unionByName(heavy).drop("n")


def orphan_rows(refs: DataFrame, missing: DataFrame) -> DataFrame:
    """Reference rows (with all their columns) whose wanted keys are missing; adds ``orphan_mask``."""
    m = missing.select(*[F.col(c).alias(f"m_{c}") for c in KEY], F.col("at").alias("m_at"), "missing")
    on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"m_{c}") for c in KEY] + [F.col("at") == F.col("m_at")])
    hit = refs.join(m, on & (F.col("mask").bitwiseAND(F.col("missing")) != 0))
    return hit.select(*refs.columns, F.col("mask").bitwiseAND(F.col("missing")).alias("orphan_mask"))


def orphan_counts(refs: DataFrame, missing: DataFrame, table_of: dict[str, str]) -> DataFrame:
    """References and orphans per source table, field and month of the record."""
    month = F.date_format(F.date_trunc("month", F.col("at")), "yyyy-MM").alias("month")
    tables = F.create_map(*[F.lit(x) for kv in table_of.items() for x in kv])
    per = ["source_table", "ref_field", "month"]
    everything = refs.filter("at is not null").select(
        tables[F.col("ref_field")].alias("source_table"), "ref_field", month, F.col("n").alias("references"), F.lit(0).cast("bigint").alias("orphans")
    )
    gone = orphan_rows(refs, missing).select(
        tables[F.col("ref_field")].alias("source_table"),
        "ref_field",
        month,
        F.lit(0).cast("bigint").alias("references"),
        F.bit_count("orphan_mask").cast("bigint").alias("orphans"),
    )
    return everything.unionByName(gone).groupBy(*per).agg(F.sum("references").alias("references"), F.sum("orphans").alias("orphans"))


# ---------------------------------------------------------------- plan-set references

#: Words that surround a sheet or detail number without naming one.
NOISE_WORDS = (
    "SEE|ON|TO|SHEETS?|SHTS?|NOS?|NUMBER|DWGS?|DRAWINGS?|AND|OR|PAGES?|PGS?|REFER|REF|CONT|CONTD|CONTINUED|PER|STD|"
    "STANDARD|DETAILS?|DTLS?|DETS?|PLANS?|PROFILES?|TYP|FOR|OF|THE|IN|N/A|NA|NONE|TBD"
)


def code_tokens(text: Column) -> Column:
    """Codes named by a loosely written reference: letters + number (+ letter), or a bare number.

    Case, separators and leading zeros are dropped: ``see dwg c-01`` gives ``C1``; a bare number
    gives digits only; text that names nothing gives an empty array.
    """
    clean = F.regexp_replace(F.upper(text), rf"(?<![A-Z0-9])(?:{NOISE_WORDS})(?![A-Z0-9])\.?", " ; ")
    raw = F.regexp_extract_all(clean, F.lit(r"(?<![A-Z0-9])([A-Z]{0,4}[\s._\-]*[0-9]+[A-Z]?)(?![A-Z0-9])"), F.lit(1))
    return F.array_distinct(
        F.transform(raw, lambda t: F.regexp_replace(F.regexp_replace(t, r"[^A-Z0-9]", ""), r"^([A-Z]*)0+(?=[0-9])", "$1"))
    )


def sheet_references(callouts: DataFrame) -> DataFrame:
    """One reference per sheet named in ``reference_sheet``; scope is the plan set."""
    return (
        callouts.filter("reference_sheet is not null and plan_id is not null")
        .select(
            F.lit("reference_sheet").alias("ref_field"),
            F.col("plan_id").alias("scope"),
            F.explode(code_tokens(F.col("reference_sheet"))).alias("block"),
            F.lit(1).cast("bigint").alias("mask"),
            F.col("extracted_at").alias("at"),
            F.lit(1).cast("bigint").alias("n"),
            F.col("callout_id").alias("record_id"),
            F.col("reference_sheet").alias("raw"),
        )
    )


def detail_references(callouts: DataFrame) -> DataFrame:
    """One reference per detail code named in ``reference_detail``; details are known to all plan sets."""
    return callouts.filter("reference_detail is not null").select(
        F.lit("reference_detail").alias("ref_field"),
        F.lit("").alias("scope"),
        F.explode(code_tokens(F.col("reference_detail"))).alias("block"),
        F.lit(1).cast("bigint").alias("mask"),
        F.col("extracted_at").alias("at"),
        F.lit(1).cast("bigint").alias("n"),
        F.col("callout_id").alias("record_id"),
        F.col("reference_detail").alias("raw"),
    )


def _tile_scope() -> Column:
    return F.concat_ws("\u0001", "plan_id", "tile_id")


def text_references(structures: DataFrame) -> DataFrame:
    """References of ``source_text_ids`` to the spans of the same plan set and tile, 64 ids to a block."""
    ids = F.filter(F.col("source_text_ids"), lambda i: i.isNotNull())
    return (
        structures.filter("source_text_ids is not null and plan_id is not null and tile_id is not null")
        .select(_tile_scope().alias("scope"), ids.alias("ids"), F.col("extracted_at").alias("at"), F.col("obs_id").alias("record_id"))
        .withColumn("b", F.explode(blocks_of(F.col("ids"))))
        .select(
            F.lit("source_text_ids").alias("ref_field"),
            "scope",
            F.col("b").cast("string").alias("block"),
            mask_of(F.col("ids"), F.col("b")).alias("mask"),
            "at",
            F.bit_count(mask_of(F.col("ids"), F.col("b"))).cast("bigint").alias("n"),
            "record_id",
            F.lit(None).cast("string").alias("raw"),
        )
    )


def sheet_targets(sheets: DataFrame) -> DataFrame:
    """A sheet is live under its label and under its bare page number."""
    keys = F.concat(F.coalesce(F.slice(code_tokens(F.col("sheet_label")), 1, 1), F.array().cast("array<string>")), F.array(F.col("page_number").cast("string")))
    return (
        sheets.filter("plan_id is not null")
        .select(F.lit("reference_sheet").alias("ref_field"), F.col("plan_id").alias("scope"), F.explode(keys).alias("block"), F.lit(1).cast("bigint").alias("mask"), F.col("registered_at").alias("start_at"), F.col("voided_at").alias("end_at"))
        .filter("block is not null")
    )


def detail_targets(register: DataFrame) -> DataFrame:
    return register.select(
        F.lit("reference_detail").alias("ref_field"),
        F.lit("").alias("scope"),
        F.explode(F.slice(code_tokens(F.col("detail_code")), 1, 1)).alias("block"),
        F.lit(1).cast("bigint").alias("mask"),
        F.col("registered_at").alias("start_at"),
        F.col("withdrawn_at").alias("end_at"),
    )


def text_targets(layers: DataFrame) -> DataFrame:
    """Spans of a text layer as one row per 64-id block; only ``text_items.text_id`` is read."""
    ids = F.filter(F.col("text_items.text_id"), lambda i: i.isNotNull())
    return (
        layers.filter("text_items is not null and plan_id is not null and tile_id is not null")
        .select(_tile_scope().alias("scope"), ids.alias("ids"), F.col("created_at").alias("start_at"), F.col("retired_at").alias("end_at"))
        .withColumn("b", F.explode(blocks_of(F.col("ids"))))
        .select(F.lit("source_text_ids").alias("ref_field"), "scope", F.col("b").cast("string").alias("block"), mask_of(F.col("ids"), F.col("b")).alias("mask"), "start_at", "end_at")
    )


SOURCE_TABLE = {"reference_sheet": "callouts", "reference_detail": "callouts", "source_text_ids": "structures"}


def plan_set_references(callouts: DataFrame, structures: DataFrame) -> DataFrame:
    return sheet_references(callouts).unionByName(detail_references(callouts)).unionByName(text_references(structures))


def plan_set_targets(sheets: DataFrame, register: DataFrame, layers: DataFrame) -> DataFrame:
    return sheet_targets(sheets).unionByName(detail_targets(register)).unionByName(text_targets(layers))


def found_rows(refs: DataFrame, missing: DataFrame) -> DataFrame:
    """Distinct ``(ref_field, record_id, ref_key)``; a key is the field as recorded or the span id."""
    bits = F.filter(
        F.sequence(F.lit(0), F.lit(63)),
        lambda i: F.call_function("shiftright", F.col("orphan_mask"), i).bitwiseAND(F.lit(1).cast("bigint")) == 1,
    )
    span_ids = F.transform(bits, lambda i: (F.expr("try_cast(block as int)") * 64 + i).cast("string"))
    keys = F.when(F.col("raw").isNotNull(), F.array("raw")).otherwise(span_ids)
    return orphan_rows(refs, missing).select("ref_field", "record_id", F.explode(keys).alias("ref_key")).distinct()
