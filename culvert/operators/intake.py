"""Text layers, sheets and tiles: coherence, classification, labels, clips, span assignment, content regions.

Per-layer measures are higher-order functions over the layer's own spans, so they need no shuffle.

Edge cases: null layers and spans count as none; a layer without spans has coherence 0 and no font; font ties
go to the font seen first; texts without any keyword are ``other``; empty tables give no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from culvert import config as C
from culvert.functions import scalars as S

PAGE_WIDTH, PAGE_HEIGHT = 2592.0, 1728.0

#: Words that tell the type of a sheet, in order of preference on ties.
SHEET_WORDS = {
    "cover": ["CIVIL IMPROVEMENT PLANS", "SHEET INDEX", "VICINITY MAP"],
    "notes": ["GENERAL NOTES", "ABBREVIATIONS", "LEGEND"],
    "demolition": ["DEMOLITION", "DEMO KEY NOTES", "REMOVALS"],
    "plan_view": ["STORM DRAIN PLAN", "UTILITY PLAN", "SEWER PLAN", "WATER PLAN", "GRADING PLAN", "IMPROVEMENT PLAN"],
    "profile": ["PROFILE", "STA:", "EXISTING GRADE"],
    "detail": ["TYPICAL", "DETAIL", "SECTION", "STANDARD"],
    "signing": ["SIGN", "STRIPING", "PAVEMENT MARKING", "TRAFFIC"],
    "erosion": ["EROSION", "SWPPP", "BMP"],
}
#: Sheet types that the small and the large model read.
FAST_TYPES = ("cover", "notes", "demolition", "erosion", "other", "signing_striping")
PREMIUM_TYPES = ("detail",)


# ------------------------------------------------------------------------------ coherence


def layer_measures(layers: DataFrame) -> DataFrame:
    """Span counts, coherence and main font of every layer, recomputed from its spans."""
    spans = F.filter(
        F.transform(S.no_nulls(F.col("text_items"), layers.schema["text_items"].dataType.simpleString()), lambda i: F.struct(F.trim(S.clean_unicode(F.coalesce(i["text"], F.lit("")))).alias("t"), F.trim(F.coalesce(i["font"], F.lit(""))).alias("f"))),
        lambda s: s["t"] != "",
    )
    fonts = F.filter(F.transform("spans", lambda s: s["f"]), lambda f: f != "")
    ranked = F.transform(F.array_distinct("fonts"), lambda f, i: F.struct(F.size(F.filter("fonts", lambda x: x == f)).alias("n"), (-i).alias("first"), f.alias("f")))
    many = lambda s: F.length(s["t"]) > 1
    out = layers.withColumn("spans", spans).withColumn("fonts", fonts).select(
        "layer_id", "plan_id", "tile_id", "page_number",
        F.size("spans").alias("total_spans"),
        F.size(F.filter("spans", many)).alias("multi_char_spans"),
        F.size(F.filter("spans", lambda s: many(s) & s["t"].rlike("[0-9]"))).alias("numeric_spans"),
        F.coalesce(F.array_max(ranked)["f"], F.lit("")).alias("primary_font"),
    )
    out = out.withColumn("coherence", F.when(F.col("total_spans") > 0, F.col("multi_char_spans") / F.col("total_spans")).otherwise(F.lit(0.0)))
    return out.withColumn("is_viable", F.col("coherence") >= C.COHERENCE_VIABLE)


def page_coherence(layers: DataFrame) -> DataFrame:
    """The same measure per page."""
    g = layer_measures(layers).groupBy("plan_id", "page_number").agg(F.sum("total_spans").alias("total_spans"), F.sum("multi_char_spans").alias("multi_char_spans"), F.sum("numeric_spans").alias("numeric_spans"))
    return g.withColumn("coherence", F.when(F.col("total_spans") > 0, F.col("multi_char_spans") / F.col("total_spans")).otherwise(F.lit(0.0)))


def routing(layers: DataFrame) -> DataFrame:
    """What is to be done with each layer: skip, escalate first, or extract."""
    c = F.col("coherence")
    return layer_measures(layers).select(
        "layer_id",
        F.when(c < C.COHERENCE_VIABLE, "skipped_low_coherence").otherwise("extract").alias("decision"),
        (c < C.COHERENCE_ESCALATE).alias("needs_escalation"),
        F.when(c < C.COHERENCE_ESCALATE, F.lit("low_coherence")).alias("escalation_reason"),
    )


# ------------------------------------------------------------------------------ sheets


def sheet_label(text: Column) -> Column:
    """First line that holds a label such as ``C-1``, else a label anywhere in the text."""
    def label(t: Column) -> Column:
        prefix, number = F.regexp_extract(t, r"(?:^|[^A-Z0-9_])([A-Z]{1,4})\s*-?\s*([0-9]{1,3}[A-Z]?)(?:$|[^A-Z0-9_])", 1), F.regexp_extract(t, r"(?:^|[^A-Z0-9_])([A-Z]{1,4})\s*-?\s*([0-9]{1,3}[A-Z]?)(?:$|[^A-Z0-9_])", 2)
        return F.when(number != "", F.concat(prefix, F.lit("-"), number))

    by_line = F.filter(F.transform(F.split(text, "\n"), lambda line: label(F.regexp_replace(F.upper(line), "[^A-Z0-9-]", ""))), lambda x: x.isNotNull())
    return F.coalesce(F.get(by_line, F.lit(0)), label(F.upper(text)))


def sheet_type(text: Column, words: dict[str, list[str]] = SHEET_WORDS) -> Column:
    """Type with the most of its words present; the first listed on ties; ``other`` if none is."""
    t = F.upper(F.coalesce(text, F.lit("")))
    scores = [F.struct(sum((F.contains(t, F.lit(w)).cast("int") for w in ws), F.lit(0)).alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, (k, ws) in enumerate(words.items())]
    best = F.array_max(F.array(*scores))
    return F.when(best["n"] > 0, best["k"]).otherwise("other")


#: Phrases, in a text padded with blanks, that name a utility.
UTILITY_PHRASES = {"SD": (" SD ", "STORM DRAIN"), "SS": (" SS ", "SANITARY SEWER", "SEWER"), "W": (" W ", " WATER ", "POTABLE WATER")}


def utility_types(text: Column) -> Column:
    t = F.upper(F.coalesce(text, F.lit("")))
    padded = F.concat(F.lit(" "), t, F.lit(" "))
    has = lambda *ws: F.exists(F.array(*[F.lit(w) for w in ws]), lambda w: F.contains(padded, w))
    return F.array_compact(F.array(*[F.when(has(*phrases), name) for name, phrases in UTILITY_PHRASES.items()]))


def model_tier(kind: Column, coherence: Column) -> Column:
    return F.when(coherence < C.COHERENCE_PREMIUM, "premium").when(kind.isin(*FAST_TYPES), "fast").when(kind.isin(*PREMIUM_TYPES), "premium").otherwise("standard")


def classified_layers(layers: DataFrame) -> DataFrame:
    """Label, type, utilities and tier of the text of every layer."""
    text = F.array_join(F.transform(S.no_nulls(F.col("text_items"), layers.schema["text_items"].dataType.simpleString()), lambda i: F.coalesce(i["text"], F.lit(""))), "\n")
    m = layer_measures(layers).select("layer_id", "coherence")
    return layers.select("layer_id", text.alias("text")).join(m, "layer_id").select(
        "layer_id", sheet_label(F.col("text")).alias("label"), sheet_type(F.col("text")).alias("sheet_type"), F.array_join(utility_types(F.col("text")), ",").alias("utilities"), model_tier(sheet_type(F.col("text")), F.col("coherence")).alias("tier")
    )


def sheet_index(lines: DataFrame) -> DataFrame:
    """Label and description of index lines ``(group_id, pos, line)``; the last line of a label wins."""
    at = r"(?:^|[^A-Z0-9_])([A-Z]{1,4}\s*-?\s*[0-9]{1,3}[A-Z]?)(?:$|[^A-Z0-9_])"
    line = F.trim("line")
    label_raw = F.regexp_extract(F.upper(line), at, 1)
    rest = F.substr(line, F.position(label_raw, F.upper(line)) + F.length(label_raw))
    d = lines.filter("line is not null").select(
        "group_id", "pos", F.regexp_replace(F.regexp_replace(label_raw, r"[^A-Z0-9-]", ""), r"^([A-Z]+)-?", "$1-").alias("label"), F.regexp_replace(rest, r"^[ \-:\t]+|[ \-:\t]+$", "").alias("description"), label_raw.alias("raw")
    ).filter("raw <> '' and description <> ''")
    return d.groupBy("group_id", "label").agg(F.max_by("description", "pos").alias("description"))


# ------------------------------------------------------------------------------ tiles and spans


def tile_clips(rows: int = 2, cols: int = 3, overlap: float = 0.10, width: float = PAGE_WIDTH, height: float = PAGE_HEIGHT) -> list[tuple]:
    """(row, col, x0, y0, x1, y1) of the fixed grid; inner edges overlap."""
    w, h = width / cols, height / rows
    return [
        (r, c, max(0.0, c * w - (w * overlap if c else 0)), max(0.0, r * h - (h * overlap if r else 0)), min(width, (c + 1) * w + (w * overlap if c < cols - 1 else 0)), min(height, (r + 1) * h + (h * overlap if r < rows - 1 else 0)))
        for r in range(rows)
        for c in range(cols)
    ]


def title_block_rect(width: float = PAGE_WIDTH, height: float = PAGE_HEIGHT) -> tuple[float, float, float, float]:
    """Bottom right quarter of the width, 35 % of the height."""
    return width * 0.75, height * 0.65, width, height


def page_clips(pages: DataFrame, **grid) -> DataFrame:
    """The clips of each page ``(plan_id, page_number)``."""
    clips = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(c, ("row", "col", "x0", "y0", "x1", "y1"))]) for c in tile_clips(**grid)])
    return pages.select("plan_id", "page_number", F.explode(clips).alias("c")).select("plan_id", "page_number", "c.*", F.format_string("p%d_r%d_c%d", F.col("page_number"), F.col("c.row"), F.col("c.col")).alias("tile_id"))


def page_spans(layers: DataFrame) -> DataFrame:
    """One row per span with its place on the page."""
    kind = layers.schema["text_items"].dataType.simpleString()
    s = layers.select("layer_id", "plan_id", "page_number", F.posexplode(S.no_nulls(F.col("text_items"), kind)).alias("pos", "i"))
    box = F.col("i.bbox_global")
    return s.select("layer_id", "plan_id", "page_number", "pos", F.trim(S.clean_unicode(F.coalesce(F.col("i.text"), F.lit("")))).alias("text"), *[F.get(box, F.lit(k)).alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))]).filter("text <> '' and x0 is not null and y1 is not null")


def spans_in_clips(layers: DataFrame, pad: float = 5.0, **grid) -> DataFrame:
    """Spans of each clip, repeated ones once, numbered from 0 in reading order, with boxes local to the clip.

    The clips a span meets follow from its own box and the grid, so no join is needed.
    """
    clips = tile_clips(**grid)
    meets = [
        F.when((F.col("x0") < c[4] + pad) & (F.col("x1") > c[2] - pad) & (F.col("y0") < c[5] + pad) & (F.col("y1") > c[3] - pad), F.struct(F.lit(c[0]).alias("row"), F.lit(c[1]).alias("col"), F.lit(c[2]).alias("cx"), F.lit(c[3]).alias("cy")))
        for c in clips
    ]
    hit = page_spans(layers).withColumn("clip", F.explode(F.array_compact(F.array(*meets))))
    keys = ["plan_id", "page_number", "row", "col"]
    hit = hit.select("plan_id", "page_number", "clip.*", "layer_id", "pos", "text", *[F.round(c, 2).alias(c) for c in ("x0", "y0", "x1", "y1")])
    first = hit.groupBy(*keys, "cx", "cy", "text", "x0", "y0", "x1", "y1").agg(F.min(F.struct("layer_id", "pos")).alias("seen"))
    return first.withColumn("text_id", F.row_number().over(W.partitionBy(*keys).orderBy("seen", "text", "x0", "y0", "x1", "y1")) - 1).select(
        *keys, "text_id", "text", F.round(F.col("x0") - F.col("cx"), 2).alias("local_x"), F.round(F.col("y0") - F.col("cy"), 2).alias("local_y")
    )


def occupied_cells(layers: DataFrame, cols: int = 24, rows: int = 16, width: float = PAGE_WIDTH, height: float = PAGE_HEIGHT) -> DataFrame:
    """Cells of the page grid that any span touches."""
    w, h = width / cols, height / rows
    s = page_spans(layers).select("plan_id", "page_number", F.greatest("x0", F.lit(0.0)).alias("x0"), F.greatest("y0", F.lit(0.0)).alias("y0"), F.least("x1", F.lit(width)).alias("x1"), F.least("y1", F.lit(height)).alias("y1")).filter("x0 < x1 and y0 < y1")
    low = lambda c, size: F.greatest(F.floor(F.col(c) / size), F.lit(0)).cast("int")
    high = lambda c, size, n: F.least(F.floor((F.col(c) - 1e-9) / size), F.lit(n - 1)).cast("int")
    s = s.withColumn("r", F.explode(F.sequence(low("y0", h), high("y1", h, rows)))).withColumn("c", F.explode(F.sequence(low("x0", w), high("x1", w, cols))))
    return s.select("plan_id", "page_number", "r", "c").distinct()


def content_regions(layers: DataFrame, cols: int = 24, rows: int = 16, padding: float = 0.05, least_area: float = 0.05, most: int = 8, width: float = PAGE_WIDTH, height: float = PAGE_HEIGHT) -> DataFrame:
    """Padded boxes of connected occupied cells per page; pages with fewer than 2 or more than ``most`` have none.

    A page has at most ``cols * rows`` cells, so a group is bounded.
    """

    def components(page: pd.DataFrame) -> pd.DataFrame:
        left = set(zip(page["r"], page["c"]))
        boxes = []
        for start in sorted(left):
            if start not in left:
                continue
            left.discard(start)
            todo, seen = [start], [start]
            while todo:
                r, c = todo.pop()
                for n in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
                    if n in left:
                        left.discard(n)
                        todo.append(n)
                        seen.append(n)
            rs, cs = [r for r, _ in seen], [c for _, c in seen]
            w, h = width / cols, height / rows
            x0, y0 = max(0.0, min(cs) * w - width * padding), max(0.0, min(rs) * h - height * padding)
            x1, y1 = min(width, (max(cs) + 1) * w + width * padding), min(height, (max(rs) + 1) * h + height * padding)
            if (x1 - x0) * (y1 - y0) >= width * height * least_area:
                boxes.append((x0, y0, x1, y1))
        if not 2 <= len(boxes) <= most:
            boxes = []
        names = ["plan_id", "page_number", "region", "x0", "y0", "x1", "y1"]
        return pd.DataFrame([(page["plan_id"].iloc[0], page["page_number"].iloc[0], i, *b) for i, b in enumerate(boxes)], columns=names)

    return occupied_cells(layers, cols, rows, width, height).groupBy("plan_id", "page_number").applyInPandas(components, "plan_id string, page_number int, region int, x0 double, y0 double, x1 double, y1 double")


def adaptive_tiles(layers: DataFrame, pages: DataFrame) -> DataFrame:
    """One tile per content region; the fixed grid for pages without regions."""
    r = content_regions(layers).select("plan_id", "page_number", F.format_string("p%d_a%d", "page_number", "region").alias("tile_id"), F.col("region").alias("row"), F.lit(0).alias("col"), "x0", "y0", "x1", "y1")
    rest = pages.select("plan_id", "page_number").distinct().join(r.select("plan_id", "page_number").distinct(), ["plan_id", "page_number"], "left_anti")
    return r.unionByName(page_clips(rest).select(*r.columns))
