"""The surviving record of each group of duplicates, chosen field by field.

Two ways are offered.  ``ranked_survivors`` takes, for each field, the value of the first record that
has one, in a fixed order of trust; it is what a stated precedence calls for.  ``discover_truth``
is iterative truth discovery: it alternately estimates how reliable each source is and which
value of each field has the most reliable support, for when no precedence is known.

Both aggregate with partial (map-side) combination of one small value per group, so a group
holding a third of all rows is never gathered in one task.

Edge cases: rows without a complete group key belong to no group; a field without any value gives no
row; ties in the order of trust end at the smaller record id, ties in truth discovery at
the smaller value; repeated rows are repeated votes; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from culvert.runtime import collect_bounded, durable

MAX_SOURCES = 10_000

#: Texts, without case and punctuation, that only say that nothing is known.
NOTHING_KNOWN = (
    "na none nonegiven nil null nan unknown unk unkn unclear notknown notgiven notshown notavailable notavail notapplicable "
    "notrecorded notspecified notstated unspecified undetermined missing nodata nodatagiven noinfo noinformation noneknown "
    "nothinggiven nothingknown nonelisted noneshown notlisted tbd tba tobedetermined tobeconfirmed tbc"
).split()


def says_something(text: Column) -> Column:
    """A text that is neither blank, nor marks only, nor a way of saying that nothing is known."""
    bare = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")
    return text.isNotNull() & (bare != "") & ~bare.isin(NOTHING_KNOWN)


def attested(number: Column, values: Column) -> Column:
    """A number that equals, to the hundredth, one of the values attested in its own row."""
    cents = F.round(number * 100).cast("bigint")
    return number.isNotNull() & ~F.isnan(number) & F.coalesce(F.exists(values, lambda v: v.isNotNull() & (F.round(v * 100).cast("bigint") == cents)), F.lit(False))


def trust_order() -> Column:
    """Smaller is more trusted: unsanitized, then more variants, then later, then smaller id."""
    last = F.lit(2**62).cast("bigint")
    return F.struct(
        F.when(F.col("sanitized") == F.lit(False), 0).otherwise(1).alias("a"),
        F.coalesce(-F.col("variants_count").cast("bigint"), last).alias("b"),
        F.coalesce(-F.unix_micros(F.col("merged_at").cast("timestamp")), last).alias("c"),
        F.col("merged_id").alias("d"),
    )


def ranked_survivors(rows: DataFrame, keys: list[str], fields: dict[str, Column], order: Column, id_column: str) -> DataFrame:
    """``(keys, field_name, id, value)``: per group of two or more rows and field, the most trusted row with a value."""
    rows = rows.dropna(subset=keys)
    typed = rows.withColumn("_o", order)
    picks = []
    for name, has_value in fields.items():
        # rows without a value have a null order and are passed over
        payload = F.struct(F.col(id_column).alias("id"), F.col(name).cast("string").alias("value"))
        picks.append(F.min_by(payload, F.when(has_value, F.col("_o"))).alias(f"_{name}"))
    grouped = typed.groupBy(*keys).agg(F.count("*").alias("_n"), *picks).filter("_n >= 2")
    each = F.array(*[F.struct(F.lit(n).alias("field_name"), F.col(f"_{n}.id").alias(id_column), F.col(f"_{n}.value").alias("value")) for n in fields])
    return grouped.select(*keys, F.explode(each).alias("_s")).select(*keys, "_s.*").filter(F.col(id_column).isNotNull())


def surviving_records(rows: DataFrame, keys: list[str], fields: dict[str, Column], order: Column) -> DataFrame:
    """One record per group of two or more rows: every field, in its own type, from the most trusted row with a value; ``records`` counts the rows."""
    typed = rows.dropna(subset=keys).withColumn("_o", order)
    picks = [F.min_by(F.col(name), F.when(has_value, F.col("_o"))).alias(name) for name, has_value in fields.items()]
    return typed.groupBy(*keys).agg(F.count("*").alias("records"), *picks).filter("records >= 2")


#: Fields of a node record by what makes them a value.
TEXT_FIELDS = ("structure_type", "station", "offset_txt", "id", "size", "notes")
NUMBER_FIELDS = ("parsed_station", "signed_offset", "tc_elevation", "fl_elevation")


def record_fields() -> dict[str, Column]:
    """All fields of a node record: texts that say something, numbers, an attested rim level, flags, inverts if there are any."""
    texts = {f: says_something(F.col(f)) for f in TEXT_FIELDS}
    numbers = {f: F.col(f).isNotNull() & ~F.isnan(F.col(f)) for f in NUMBER_FIELDS}
    return {**texts, **numbers, "rim_elevation": attested(F.col("rim_elevation"), F.col("rim_elevation_values")), "is_existing": F.col("is_existing").isNotNull(), "page_number": F.col("page_number").isNotNull(), "inverts": F.size("inverts") > 0}


def node_fields() -> dict[str, Column]:
    return {
        "rim_elevation": attested(F.col("rim_elevation"), F.col("rim_elevation_values")),
        "size": says_something(F.col("size")),
        "notes": says_something(F.col("notes")),
    }


def discover_truth(claims: DataFrame, keys: list[str], rounds: int = 50, prior: float = 0.8, epsilon: float = 1e-4) -> DataFrame:
    """Iterative truth discovery over ``(keys..., field_name, source, value)``.

    A source's reliability starts at ``prior``; each round gives every value the summed log-odds of
    the sources that claim it, takes the best value per field, and re-estimates each source as the
    smoothed share of its claims that agree.  Claims are first counted per distinct
    (group, field, source, value), which is written once; a round reads that table and the register of sources.
    It ends when no reliability changes by more than ``epsilon``; if ``rounds`` are too few for that, it raises.
    """
    unit = [*keys, "field_name"]
    votes = durable(claims.dropna(subset=[*unit, "source", "value"]).groupBy(*unit, "source", "value").agg(F.count("*").alias("n")))
    known = {r["source"]: prior for r in collect_bounded(votes.select("source").distinct(), MAX_SOURCES, "sources")}
    change = 0.0
    for _ in range(rounds):
        # the register of sources is bounded, so it may go to every worker
        sources = votes.sparkSession.createDataFrame(sorted(known.items()), "source string, reliability double")
        odds = F.log(F.col("reliability") / (1 - F.col("reliability")))
        scored = votes.join(F.broadcast(sources), "source").groupBy(*unit, "value").agg(F.sum(odds * F.col("n")).alias("support"))
        best = scored.groupBy(*unit).agg(
            F.min_by(F.struct("value", "support"), F.struct((-F.col("support")).alias("s"), F.col("value").alias("v"))).alias("b")
        ).select(*unit, F.col("b.value").alias("value"), F.round("b.support", 6).alias("support"))
        won = votes.join(best.select(*unit, F.col("value").alias("best_value")), unit)
        agree = F.sum(F.when(F.col("value") == F.col("best_value"), F.col("n")).otherwise(0))
        new = {r["source"]: r["r"] for r in collect_bounded(won.groupBy("source").agg(((agree + 2 * prior) / (F.sum("n") + 2)).alias("r")), MAX_SOURCES, "sources")}
        change = max((abs(new[s] - known[s]) for s in new), default=0.0)
        if change <= epsilon:
            return best
        known = new
    raise ValueError(f"truth discovery: a reliability still changes by {change} after {rounds} rounds")


def node_claims(merged: DataFrame) -> DataFrame:
    """Claims of merge runs on node fields; a source is a class of rows: sanitized state and number of variants.

    A run is no source: there are nearly as many runs as records, so nothing could be learned of one.
    """
    source = F.concat_ws(
        "/",
        F.coalesce(F.col("sanitized").cast("string"), F.lit("?")),
        F.coalesce(F.col("variants_count").cast("string"), F.lit("?")),
    )
    fields = node_fields()
    each = F.array(*[F.struct(F.lit(n).alias("field_name"), F.when(ok, F.col(n).cast(T.StringType())).alias("value")) for n, ok in fields.items()])
    return merged.select("plan_id", "node_id", source.alias("source"), F.explode(each).alias("c")).select("plan_id", "node_id", "source", "c.*")
