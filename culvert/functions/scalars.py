"""Scalar functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from culvert import config as C

STATION = r"(?i)(?:STA[:.]?\s*)?(\d{1,4})\s*\+\s*(\d{1,2}(?:\.\d+)?)"
OFFSET = r"(-?\d+(?:\.\d+)?)\s*(?:'|FT|FEET)?\s*([LR])T?"


def number(text: Column) -> Column:
    """Text as double; blank or unreadable is null."""
    return F.nullif(F.trim(text), F.lit("")).try_cast("double")


def parse_station(text: Column) -> Column:
    """First ``hundreds+rest`` in a text, in feet; null if there is none."""
    return number(F.regexp_extract(text, STATION, 1)) * 100.0 + number(F.regexp_extract(text, STATION, 2))


def offset_distance(text: Column) -> Column:
    return number(F.regexp_extract(F.upper(F.translate(text, ",", " ")), OFFSET, 1))


def offset_side(text: Column) -> Column:
    """RT, LT or null."""
    side = F.regexp_extract(F.upper(F.translate(text, ",", " ")), OFFSET, 2)
    return F.when(side == "R", "RT").when(side == "L", "LT")


def signed_offset(text: Column) -> Column:
    """Right positive, left negative; a zero has no sign."""
    d = offset_distance(text)
    return F.when(offset_side(text) == "LT", -d).otherwise(d) + F.lit(0.0)


def offset_or_center(text: Column) -> Column:
    """An absent offset is on the centre line."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("0' CL"))


def effective_offset(text: Column) -> Column:
    t = offset_or_center(text)
    return F.coalesce(signed_offset(t), F.when(F.upper(t).contains("CL"), 0.0))


def norm_token(text: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), "[^A-Z0-9]+", "")


def norm_type(text: Column) -> Column:
    """Snake-case type label."""
    return F.regexp_replace(F.translate(F.lower(F.trim(F.coalesce(text, F.lit("")))), "- ", "__"), "[^a-z0-9_]+", "")


def norm_size(text: Column) -> Column:
    return F.replace(F.upper(F.coalesce(text, F.lit(""))), F.lit(" "), F.lit(""))


def diameter_ft(text: Column) -> Column:
    """First number of a pipe size, inches to feet."""
    return number(F.regexp_extract(text, r"(\d+(?:\.\d+)?)", 1)) / 12.0


def clean_unicode(text: Column) -> Column:
    """Symbols replaced by plain text."""
    # fixed values: symbol -> replacement
    for symbol, plain in (("∅", "DIA"), ("Ø", "DIA"), ("⌀", "DIA"), ("°", "deg"), ("′", "'"), ("″", '"'), ("±", "+/-")):
        text = F.replace(text, F.lit(symbol), F.lit(plain))
    return text


def distinct_sorted(values: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(values, lambda v: v.isNotNull())))


def no_nulls(values: Column, of: str) -> Column:
    """An array without null elements; null is the empty array."""
    return F.coalesce(F.filter(values, lambda v: v.isNotNull()), F.array().cast(of))


def ordinal(confidence: Column) -> Column:
    """none 0 … high 3."""
    return F.array_position(F.array(*[F.lit(c) for c in C.CONFIDENCES]), confidence).cast("int") - 1


def confidence_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in C.CONFIDENCES]), rank + 1)


def worse(a: Column, b: Column) -> Column:
    return confidence_name(F.least(ordinal(a), ordinal(b)))


def extraction_confidence(coherence: Column, sanitized: Column) -> Column:
    """A sanitised record is never high, but never low either."""
    return (
        F.when((coherence >= C.CONFIDENCE_HIGH) & ~sanitized, "high")
        .when((coherence >= C.CONFIDENCE_MEDIUM) | sanitized, "medium")
        .otherwise("low")
    )


def quality_grade(ratio: Column) -> Column:
    return F.when(ratio <= C.GRADE_A, "A").when(ratio <= C.GRADE_B, "B").when(ratio <= C.GRADE_C, "C").otherwise("D")


def hint_score(blob: Column, hint: Column) -> Column:
    """2: the whole hint occurs in the node's text; 1: one of its words does; 0: neither."""
    h = F.trim(F.regexp_replace(F.upper(F.coalesce(hint, F.lit(""))), r"\s+", " "))
    words = F.filter(F.split(h, "[^A-Z0-9]+"), lambda w: w != "")
    return F.when(h == "", 0).when(F.contains(blob, h), 2).when(F.exists(words, lambda w: F.contains(blob, w)), 1).otherwise(0)


def match_confidence(distance: Column, score: Column) -> Column:
    return (
        F.when(distance.isNull(), F.when(score >= 1, "medium").otherwise("none"))
        .when((score >= 2) & (distance <= C.HINT_CLOSE_FT), "high")
        .when((score >= 1) & (distance <= C.HINT_MEDIUM_FT), "medium")
        .when(distance <= C.HINT_CLOSE_FT, "medium")
        .when(distance <= C.HINT_FAR_FT, "low")
        .otherwise("none")
    )


def inferred_confidence(delta: Column) -> Column:
    """An endpoint inferred from a length is never better than low."""
    return F.when(delta <= C.INFER_LOW_FT, "low").otherwise("none")


def node_id(utility: Column, page: Column, raw_type: Column, station: Column, offset: Column, station_ft: Column, offset_ft: Column) -> Column:
    """Readable id of a located structure; a digest of the raw texts where it cannot be located."""
    kind = F.coalesce(F.nullif(norm_token(raw_type), F.lit("")), F.lit("STRUCT"))
    raw = F.concat_ws("|", utility, page.cast("string"), F.coalesce(raw_type, F.lit("None")), F.coalesce(station, F.lit("None")), F.coalesce(offset, F.lit("None")))
    return F.when(
        station_ft.isNotNull() & offset_ft.isNotNull(),
        F.format_string("%s:%d:%s:%.2f:%+.2f", utility, page, kind, station_ft, offset_ft),
    ).otherwise(F.concat_ws(":", utility, page.cast("string"), kind, F.substring(F.sha1(raw), 1, 10)))


def page_of_tile(tile_id: Column) -> Column:
    return F.nullif(F.regexp_extract(tile_id, r"(?i)^p(\d+)_(?:r\d+_c\d+|a\d+)$", 1), F.lit("")).try_cast("int")


def normalize_status(status: Column) -> Column:
    s = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    return F.when(s.isin(*C.STATUSES), s).otherwise("runtime_error")


def is_existing(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("true", "1", "yes", "y"), F.lit(False))


def page_list(text: Column) -> Column:
    """``1-3,7`` as sorted distinct page numbers; null for blank; an inverted range or a page below 1 is an error."""
    tokens = F.filter(F.transform(F.split(text, ","), lambda t: F.trim(t)), lambda t: t != "")
    first = lambda t: F.trim(F.split_part(t, F.lit("-"), F.lit(1))).try_cast("int")
    last = lambda t: F.when(F.contains(t, F.lit("-")), F.trim(F.split_part(t, F.lit("-"), F.lit(2))).try_cast("int")).otherwise(first(t))
    ranges = F.transform(
        tokens, lambda t: F.when(first(t).isNull() | last(t).isNull() | (last(t) < first(t)) | (first(t) < 1), F.raise_error(F.concat(F.lit("invalid pages: "), t)).cast("array<int>")).otherwise(F.sequence(first(t), last(t)))
    )
    pages = F.array_sort(F.array_distinct(F.flatten(ranges)))
    return F.when(F.size(pages) > 0, pages)


def json_candidate(text: Column) -> Column:
    """The part of a reply that is most likely a JSON object; null if there is none."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    fenced = F.nullif(F.regexp_extract(text, r"(?i)```(?:json)?\s*(\{[\s\S]*\})\s*```", 1), F.lit(""))
    first, last = F.locate("{", t), F.length(t) - F.locate("}", F.reverse(t)) + 1
    inner = F.when((first > 0) & (F.locate("}", t) > 0) & (last > first), F.substring(t, first, last - first + 1))
    return F.when(t.startswith("{") & t.endswith("}"), t).otherwise(F.coalesce(fenced, inner))


def cache_key(*parts: Column) -> Column:
    """First 16 digits of the digest of the canonical JSON of named parts (names in alphabetical order)."""
    return F.substring(F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256), 1, 16)


def salvage_objects(text: Column) -> Column:
    """Flat JSON objects inside a broken text; what looks like one but cannot be read is left out."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"(\{[^{}]+\})"), F.lit(1)), lambda o: F.json_object_keys(o).isNotNull())


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "error", 0).when(severity == "warning", 1).when(severity == "info", 2).otherwise(99)


def slug(text: Column) -> Column:
    """Words joined by hyphens; ``run`` if nothing is left."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\w]+", "-"), r"^-+|-+$", "")
    return F.coalesce(F.nullif(t, F.lit("")), F.lit("run"))
