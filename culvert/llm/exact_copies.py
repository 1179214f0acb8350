"""Records that are the same but for formatting, collapsed to one each with their number of copies.

A record's canonical key is a 128-bit digest of all its compared columns; loosely formatted text
columns are first reduced to their parts (whole words, initials, numbers with decimal point and their foot or
inch mark) without white space, case, punctuation and order of parts.

Skew: keys are counted with partial (map-side) counts; the keys holding at least ``hot_share`` of
all rows are known exactly and number at most ``1 / hot_share``.  Hot groups are salted by
record id and reduced in two levels; all others take one shuffle.  When copies are listed, the
representatives of the hot groups (bounded in number) are broadcast to their rows, and
only rows of the other groups that have copies are joined by shuffle.

Edge cases: nulls equal each other; empty and blank texts are equal to each other but not to null;
records without copies are groups of one; repeated ids cannot occur; empty tables give no rows;
extra columns belong to the compared columns unless they are named as ignored.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from culvert.runtime import collect_bounded, durable


#: A part: initials, a word, a number with the mark that belongs to it, or a mark on its own.
PART = r"(?:\p{L}\.)+\p{L}\b|\p{L}+|(?:\d+/\d+|\d+(?:\.\d+)?|\.\d+)['\"]?|['\"]"


def canonical_parts(text: Column) -> Column:
    """Order-free canonical form of a loosely formatted text: its parts, sorted as wholes.

    Letters stay in their word and marks with their number, so ``8' 6"`` and ``6' 8"``, or ``PVC`` and ``CPV``, stay apart.
    """
    t = F.lower(F.regexp_replace(text, "[∅⌀]", "ø"))
    t = F.regexp_replace(t, "[′’‘´`ʹ＇]", "'")
    t = F.regexp_replace(t, "[″”“ʺ＂]", '"')
    t = F.regexp_replace(t, r"'\s*'", '"')
    t = F.regexp_replace(t, r"(\d),(\d{3})(?!\d)", "$1$2")
    # a mark belongs to the number before it, or, where the text has one number and one mark, to that number
    t = F.regexp_replace(t, r"(\d)[\s ]+(['\"])", "$1$2")
    t = F.regexp_replace(t, r"^([^\d'\"]*)(['\"])([^\d'\"]*?)(\d+(?:\.\d+)?|\.\d+)([^\d'\"]*)$", "$1$3$4$2$5")
    parts = F.regexp_extract_all(t, F.lit(f"({PART})"), F.lit(1))
    return F.array_join(F.array_sort(F.transform(parts, lambda p: F.when(p.rlike(r"^\p{L}"), F.translate(p, ".", "")).otherwise(p))), " ")


def with_key(df: DataFrame, id_column: str, ignored: list[str], loose: list[str]) -> DataFrame:
    """``(id, key)``: the digest over all columns but the id and the ignored ones; loose columns in canonical form."""
    compared = [c for c in sorted(df.columns) if c not in (id_column, *ignored)]
    # a null and an empty text stay apart: to_json keeps null fields
    parts = [F.when(F.col(c).isNotNull(), canonical_parts(F.col(c))).alias(c) if c in loose else F.col(c) for c in compared]
    return df.select(F.col(id_column).alias("id"), F.unhex(F.md5(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}))).alias("key"))


def _hot(keyed: DataFrame, hot_share: float) -> list:
    counts = keyed.groupBy("kind", "key").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).collect()[0][0] or 0
    if not total:
        return []
    return collect_bounded(counts.filter(F.col("n") >= max(3, ceil(total * hot_share))).select("kind", "key"), int(1 / hot_share) + 1, "hot keys")


def _in(keys: list) -> Column:
    if not keys:
        return F.lit(False)
    return F.struct("kind", "key").isin([F.struct(F.lit(k["kind"]), F.lit(bytes(k["key"]))) for k in keys])


def group_heads(keyed: DataFrame, hot: list, salts: int = 64) -> tuple[DataFrame, DataFrame]:
    """``(kind, key, first_id, copies)`` of the hot groups, by two levels, and of all others, by one shuffle."""
    one = keyed.filter(~_in(hot)).groupBy("kind", "key").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))
    level = keyed.filter(_in(hot)).groupBy("kind", "key", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt")).agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))
    two = level.groupBy("kind", "key").agg(F.min("first_id").alias("first_id"), F.sum("copies").alias("copies"))
    return two, one


def collapse(keyed: DataFrame, hot_share: float = 1 / 48) -> DataFrame:
    """One row per distinct record: its representative and its number of copies (itself included)."""
    two, one = group_heads(keyed, _hot(keyed, hot_share))
    return two.unionByName(one).select("kind", "first_id", "copies")


def copies(keyed: DataFrame, hot_share: float = 1 / 48) -> DataFrame:
    """``(kind, first_id, copy_id)``: one row per copy other than the representative."""
    hot = _hot(keyed, hot_share)
    two, one = group_heads(keyed, hot)
    listed = keyed.filter(~_in(hot)).join(one.filter("copies > 1").select("kind", "key", "first_id"), ["kind", "key"])
    if hot:
        listed = listed.unionByName(keyed.filter(_in(hot)).join(F.broadcast(two.select("kind", "key", "first_id")), ["kind", "key"]))
    return listed.filter("id <> first_id").select("kind", "first_id", F.col("id").alias("copy_id"))


def plan_set_records(structures: DataFrame, pipes: DataFrame) -> DataFrame:
    """Keyed structures and pipes; the id and ``ingested_at`` are not compared."""
    # the keys are needed several times and are small; the records themselves are digested once
    s = with_key(structures, "obs_id", ["ingested_at"], ["offset_txt"]).withColumn("kind", F.lit("structure"))
    p = with_key(pipes, "pipe_id", ["ingested_at"], ["size", "material"]).withColumn("kind", F.lit("pipe"))
    return durable(s.unionByName(p))
