"""Entities of two sources matched without a shared key, each match with a confidence.

Candidates come from blocks only: the same street (after normalisation, and with typing errors by a
deletion-neighbourhood join of the distinct names) and the same stretch of stationing, or,
where the asset has no chainage or the observation no station, the same street and tag number.

Labelling functions vote agree / near / disagree / abstain on each candidate: station, lateral offset, kind,
tag, rim level and street spelling.  The votes of all candidates are reduced to counts per vote
pattern (a bounded table, whatever the size of the data), and a generative label model is fitted to
it by expectation maximisation: a latent match variable with, per class, a dependency tree of the
functions (Chow-Liu), so that their accuracies and their correlations are learned without
labels.  Its posterior is the confidence of a candidate.

An asset is one real thing: its most confident observation is its anchor, and all observations of the
anchor's thing (same plan set, street, kind and position, or the same id where a position is
missing) are paired with the asset.  Each of these pairs then votes for itself, candidate before or not, with
one more function that says how it belongs to the thing, and a second label model, fitted to the pairs
and to the candidates that belong to no thing, gives its posterior.  That posterior decides and is the
confidence.  ``consistent`` only limits which candidate may become an anchor.

Edge cases: rows without street, or without both position and tag, have no candidates; null attributes
abstain; an asset surveyed twice is two assets; ties between anchors go to the smaller
observation id; repeated rows pair like any others; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import defaultdict
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from culvert.functions import units as U
from culvert.llm.canonical_values import code_of
from culvert.operators.units import factors, noted_units, position_parts, tile_units, unit_and_value
from culvert.runtime import collect_bounded, durable

#: Street suffixes and their short forms.
SUFFIXES = {
    "drive": "dr dr drv",
    "street": "st str",
    "avenue": "ave av aven",
    "boulevard": "blvd boul bvd",
    "lane": "ln",
    "road": "rd",
    "court": "ct crt",
    "parkway": "pkwy pky pwy",
    "place": "pl",
    "terrace": "ter terr",
    "circle": "cir",
    "highway": "hwy",
    "way": "wy",
}
BUCKET = 16.0
REACH = 12.0
VOTES = ["v_station", "v_lateral", "v_kind", "v_tag", "v_rim", "v_street"]
MAX_PATTERNS = 5_000


# ------------------------------------------------------------------------------ streets


def street_parts(name: Column) -> Column:
    """struct(base, suffix): lower-case words; a known last word is the suffix in its long form, else ''."""
    words = F.filter(F.split(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    known = {k: k for k in SUFFIXES} | {s: k for k, v in SUFFIXES.items() for s in v.split()}
    suffix = U._map(known)[F.element_at(F.when(F.size(words) > 1, words), -1)]
    base = F.when(suffix.isNotNull(), F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(1)))).otherwise(words)
    return F.struct(F.array_join(base, " ").alias("base"), F.coalesce(suffix, F.lit("")).alias("suffix"))


def _near(base: Column) -> Column:
    """A text and all texts with one character less."""
    cut = F.transform(F.sequence(F.lit(1), F.length(base)), lambda i: F.concat(F.substring(base, F.lit(1), i - 1), F.substring(base, i + 1, F.length(base))))
    return F.array_distinct(F.concat(F.array(base), F.when(F.length(base) > 0, cut).otherwise(F.array().cast("array<string>"))))


def match_streets(drawn: DataFrame, named: DataFrame) -> DataFrame:
    """``(name, base, suffix, exact)``: the drawn streets a survey name can mean.

    ``drawn`` has distinct ``(base, suffix)``; ``named`` distinct ``name``.  Names that match no street
    exactly are compared by edit distance, also with their last word taken as a misspelt suffix.
    """
    whole = F.struct(F.array_join(F.filter(F.split(F.regexp_replace(F.lower("name"), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != ""), " ").alias("base"), F.lit("").alias("suffix"))
    # a survey name may leave the suffix out, and its last word only look like one
    n = named.select("name", F.explode(F.array_distinct(F.array(street_parts(F.col("name")), whole))).alias("p")).select("name", F.col("p.base").alias("n_base"), F.col("p.suffix").alias("n_suffix"))
    compatible = (F.col("n_suffix") == "") | (F.col("suffix") == "") | (F.col("n_suffix") == F.col("suffix"))
    exact = n.join(drawn, F.col("n_base") == F.col("base")).filter(compatible).select("name", "base", "suffix", F.lit(True).alias("exact")).distinct()
    rest = n.join(exact.select("name").distinct(), "name", "left_anti")
    last = F.element_at(F.split("n_base", " "), -1)
    misspelt = F.coalesce(*[F.when(F.levenshtein(last, F.lit(s)) <= (2 if len(s) >= 5 else 1), F.lit(s)) for s in SUFFIXES], F.lit(""))
    cut_base = F.regexp_replace("n_base", r" [^ ]+$", "")
    forms = rest.select(
        "name",
        F.explode(
            F.array_distinct(
                F.array(
                    F.struct(F.col("n_base").alias("n_base"), F.col("n_suffix").alias("n_suffix")),
                    F.when((F.col("n_suffix") == "") & (misspelt != ""), F.struct(cut_base.alias("n_base"), misspelt.alias("n_suffix"))).otherwise(F.struct(F.col("n_base").alias("n_base"), F.col("n_suffix").alias("n_suffix"))),
                )
            )
        ).alias("f"),
    ).select("name", "f.*").filter(F.length("n_base") >= 5)
    left = forms.select("name", "n_base", "n_suffix", F.explode(_near(F.col("n_base"))).alias("k"))
    right = drawn.filter(F.length("base") >= 5).select("base", "suffix", F.explode(_near(F.col("base"))).alias("k"))
    close = left.join(right, "k").filter(compatible & (F.levenshtein("n_base", "base") <= 2)).select("name", "base", "suffix", F.lit(False).alias("exact"))
    return exact.unionByName(close.distinct())


# ------------------------------------------------------------------------------ features


def _tag(text: Column, side: str) -> list[Column]:
    t = F.upper(text)
    number = F.regexp_replace(F.regexp_extract(t, r"(\d+)(?!.*\d)", 1), r"^0+(?=\d)", "")
    return [F.nullif(number, F.lit("")).alias(f"{side}_number"), F.nullif(F.regexp_replace(t, r"[^A-Z]", ""), F.lit("")).alias(f"{side}_prefix")]


def asset_features(assets: DataFrame, kind_of) -> DataFrame:
    """Survey assets with position in feet, canonical kind, tag parts and rim level."""
    plus = r"(\d+)\s*\+\s*(\d+)((?:\.\d+)?)"
    minor = F.regexp_extract("chainage", plus, 2)
    # the digits after the plus tell its worth: 2 for hundreds, 3 for thousands
    with_plus = U._double(F.regexp_extract("chainage", plus, 1)) * F.pow(F.lit(10.0), F.length(minor)) + U._double(F.concat(minor, F.regexp_extract("chainage", plus, 3)))
    station = F.coalesce(with_plus, U.number_of("chainage")) * U.length_scale(F.coalesce(U.length_unit_of("chainage"), F.lit("ft")))
    lateral = U.signed_number("lateral_txt") * U.length_scale(F.coalesce(U.length_unit_of("lateral_txt"), F.lit("ft")))
    return assets.select(
        "asset_id",
        F.col("street_name").alias("name"),
        station.alias("a_station"),
        lateral.alias("a_lateral"),
        kind_of(F.col("asset_kind")).alias("a_kind"),
        *_tag(F.col("asset_tag"), "a"),
        F.when(~F.isnan("rim_level"), F.col("rim_level")).alias("a_rim"),
    )


def tile_streets(tiles: DataFrame) -> DataFrame:
    """``(plan_id, tile_id, base, suffix, tiled)``: the streets of each tile and the units its notes state."""
    streets = (
        tiles.filter("street_names is not null and plan_id is not null and tile_id is not null")
        .select("plan_id", "tile_id", F.explode("street_names").alias("s"))
        .filter("s is not null")
        .select("plan_id", "tile_id", street_parts(F.col("s")).alias("p"))
        .select("plan_id", "tile_id", "p.base", "p.suffix")
        .distinct()
    )
    return streets.join(tile_units(tiles).withColumnsRenamed({"t_plan": "plan_id", "t_tile": "tile_id"}), ["plan_id", "tile_id"], "left")


def observation_features(structures: DataFrame, tiles: DataFrame, kind_of, scale_of: dict[str, float]) -> DataFrame:
    """Structure observations with street, position in feet, canonical kind, id parts and rim level.

    Everything is read in one pass over the observations; the streets and units of their tiles come by one join.
    """
    rim = F.coalesce("rim_elevation", "tc_elevation", "fl_elevation")
    plain = structures.filter("plan_id is not null and tile_id is not null").select(
        "obs_id", "plan_id", "tile_id", *_tag(F.col("id"), "o"), F.when(~F.isnan(rim), rim).alias("o_rim"), "structure_type", noted_units(F.col("notes"), "station", "offset_txt").alias("noted"),
        U.plain_marks(F.col("station")).alias("_s"), U.plain_marks(F.col("offset_txt")).alias("_o"),
    )
    read = plain.select("obs_id", "plan_id", "tile_id", "o_number", "o_prefix", "o_rim", "noted", position_parts("_s", "_o").alias("qs"), kind_of(F.col("structure_type")).alias("o_kind"))
    placed = read.join(tile_streets(tiles), ["plan_id", "tile_id"]).withColumn("at", F.expr(f"transform(qs, q -> {unit_and_value(scale_of)}.common_value)"))
    known = lambda i: F.when(~F.isnan(F.col("at")[i]), F.col("at")[i])
    return placed.select("obs_id", "plan_id", "base", "suffix", known(0).alias("o_station"), known(1).alias("o_lateral"), "o_kind", "o_number", "o_prefix", "o_rim")


# ------------------------------------------------------------------------------ candidates and votes


def candidates(placed: DataFrame, obs: DataFrame) -> DataFrame:
    """Pairs of the same street and stretch, or of the same street and tag number where one side has no position."""
    low, high = F.floor((F.col("a_station") - REACH) / BUCKET), F.floor((F.col("a_station") + REACH) / BUCKET)
    near = (
        placed.filter("a_station is not null")
        .withColumn("bucket", F.explode(F.sequence(low, high)))
        .join(obs.filter("o_station is not null").withColumn("bucket", F.floor(F.col("o_station") / BUCKET)), ["base", "suffix", "bucket"])
        .filter(F.abs(F.col("a_station") - F.col("o_station")) <= REACH)
        .drop("bucket")
    )
    tagged = (
        placed.filter("a_number is not null")
        .join(obs.filter("o_number is not null").withColumn("a_number", F.col("o_number")), ["base", "suffix", "a_number"])
        .filter("a_station is null or o_station is null")
        .select(near.columns)
    )
    return near.unionByName(tagged)


def votes(pairs: DataFrame) -> DataFrame:
    """One column per labelling function: 2 agree, 1 near, 0 abstain, -1 disagree."""
    d, lat, rim = F.abs(F.col("a_station") - F.col("o_station")), F.abs(F.col("a_lateral") - F.col("o_lateral")), F.abs(F.col("a_rim") - F.col("o_rim"))
    same_number = F.col("a_number") == F.col("o_number")
    clash = F.col("a_prefix").isNotNull() & F.col("o_prefix").isNotNull() & (F.col("a_prefix") != F.col("o_prefix"))
    return pairs.select(
        "*",
        F.when(d.isNull(), 0).when(d <= 1.5, 2).when(d <= 3.3, 1).otherwise(-1).alias("v_station"),
        F.when(lat.isNull(), 0).when(lat <= 0.6, 2).when(lat <= 1.3, 1).otherwise(-1).alias("v_lateral"),
        F.when(F.col("a_kind").isNull() | F.col("o_kind").isNull(), 0).when(F.col("a_kind") == F.col("o_kind"), 2).otherwise(-1).alias("v_kind"),
        F.when(F.col("a_number").isNull() | F.col("o_number").isNull(), 0).when(same_number & ~clash, 2).otherwise(-1).alias("v_tag"),
        F.when(rim.isNull(), 0).when(rim <= 0.15, 2).when(rim <= 1.0, 1).otherwise(-1).alias("v_rim"),
        F.when(F.col("exact"), 2).otherwise(1).alias("v_street"),
    )


class LabelModel:
    """Latent-class model of vote patterns with a dependency tree of the functions per class."""

    def __init__(self, patterns: dict[tuple, int], start=None, rounds: int = 30, smoothing: float = 0.5, least_information: float = 0.02):
        self.rows = sorted(patterns.items())
        self.k = len(self.rows[0][0]) if self.rows else 0
        self.values = [sorted({p[j] for p, _ in self.rows}) for j in range(self.k)]
        self.smoothing = smoothing
        q = {p: (start or self._balance)(p) for p, _ in self.rows}
        # the classes are found with independent functions; only what they leave unexplained is then a correlation
        for _ in range(rounds):
            q = self._round(q, [{}, {}])
        parents = [self._tree(self._tables(q, c), least_information) for c in (0, 1)]
        for _ in range(5):
            q = self._round(q, parents)

    @staticmethod
    def _balance(p: tuple) -> float:
        """Start from the vote balance, a disagreement weighing more than an agreement."""
        return 1 / (1 + math.exp(-(sum(v for v in p[:-1] if v > 0) + 3 * sum(v for v in p[:-1] if v < 0) - 2.5)))

    def _round(self, q: dict, parents: list[dict]) -> dict:
        self.trees = [self._tables(q, c) | {"parent": parents[c]} for c in (0, 1)]
        total = sum(n for _, n in self.rows)
        self.prior = min(max(sum(q[p] * n for p, n in self.rows) / max(total, 1), 1e-3), 1 - 1e-3)
        return {p: self.posterior(p) for p, _ in self.rows}

    def _tables(self, q: dict, c: int) -> dict:
        """Weighted counts of single votes and pairs of votes in one class."""
        single = [defaultdict(float) for _ in range(self.k)]
        double = {ij: defaultdict(float) for ij in combinations(range(self.k), 2)}
        total = 1e-9
        for p, n in self.rows:
            x = n * (q[p] if c else 1 - q[p])
            total += x
            for j in range(self.k):
                single[j][p[j]] += x
            for i, j in double:
                double[i, j][p[i], p[j]] += x
        return {"total": total, "single": single, "double": double}

    def _tree(self, t: dict, least: float) -> dict:
        """Chow-Liu forest: each function's parent, where the two share at least some information within the class."""
        info = {
            (i, j): sum(x / t["total"] * math.log(x * t["total"] / (t["single"][i][a] * t["single"][j][b])) for (a, b), x in d.items() if x > 1e-12)
            for (i, j), d in t["double"].items()
        }
        inside, parent = {0}, {}
        while len(inside) < self.k:
            i, j = max(((a, b) for a in inside for b in range(self.k) if b not in inside), key=lambda ab: info[min(ab), max(ab)])
            inside.add(j)
            if info[min(i, j), max(i, j)] >= least:
                parent[j] = i
        return parent

    def _likelihood(self, tree: dict, p: tuple) -> float:
        out, s = 0.0, self.smoothing
        for j in range(self.k):
            own, up = tree["single"][j], tree["parent"].get(j)
            marginal = (own[p[j]] + s) / (tree["total"] + s * len(self.values[j]))
            if up is None:
                out += math.log(marginal)
                continue
            pair = tree["double"][min(up, j), max(up, j)][(p[up], p[j]) if up < j else (p[j], p[up])]
            # backed off to the marginal, so that rare parents do not overrule their child
            out += math.log((pair + 5 * s * marginal) / (tree["single"][up][p[up]] + 5 * s))
        return out

    def posterior(self, p: tuple) -> float:
        a, b = (math.log(x) + self._likelihood(t, p) for x, t in zip((1 - self.prior, self.prior), self.trees))
        return 1 / (1 + math.exp(min(max(a - b, -60), 60)))


def pattern_counts(voted: DataFrame, columns: list[str]) -> dict[tuple, int]:
    """Rows per vote pattern: a bounded table, whatever the size of the data."""
    counts = collect_bounded(voted.groupBy(*columns).agg(F.count("*").alias("n")), MAX_PATTERNS, "vote patterns")
    return {tuple(r[v] for v in columns): r["n"] for r in counts}


def confident(voted: DataFrame, columns: list[str], posterior: dict[tuple, float]) -> DataFrame:
    """Adds the posterior of each row's vote pattern as ``confidence``; the table of patterns is bounded."""
    table = voted.sparkSession.createDataFrame([(*p, x) for p, x in posterior.items()], ", ".join(f"{v} int" for v in columns) + ", confidence double")
    return voted.join(F.broadcast(table), columns)


# ------------------------------------------------------------------------------ things


def consistent() -> Column:
    """Exact check after the model: no attribute known on both sides contradicts.

    A far position needs the same tag, or the same kind and no other rim level; how much such a pair is
    worth is left to the posterior.  The same rim level does not excuse the other side of the line:
    twins facing each other there have equal rims.
    """
    side = (F.col("v_lateral") >= 0) | (F.col("v_tag") == 2)
    same_kind = F.col("v_kind") == 2
    place = (F.col("v_station") >= 0) | (F.col("v_tag") == 2) | (same_kind & ((F.col("v_lateral") == 2) | (F.col("v_rim") >= 0)))
    return (F.col("v_kind") >= 0) & (F.col("v_tag") >= 0) & side & place


def with_known_tags(anchor: DataFrame, sure: DataFrame) -> DataFrame:
    """Anchors without a tag take the one of the asset's confident observations at the anchor's place, if these name one number only."""
    at_place = (F.col("plan_id") == F.col("t_plan_id")) & (F.col("base") == F.col("t_base")) & (F.col("suffix") == F.col("t_suffix")) & (F.abs(F.col("o_station") - F.col("t_o_station")) <= 2)
    kind = F.coalesce(F.col("o_kind") == F.col("t_kind"), F.lit(True))
    side = F.coalesce(F.abs(F.coalesce("t_o_lateral", "t_a_lateral") - F.col("o_lateral")) <= 1.3, F.lit(True))
    known = (
        sure.filter("o_number is not null")
        .select("asset_id", "plan_id", "base", "suffix", "o_station", "o_lateral", "o_kind", "o_number", "o_prefix")
        .join(anchor.filter("t_number is null"), "asset_id")
        .filter(at_place & kind & side)
        .groupBy("asset_id")
        .agg(F.min("o_number").alias("k_number"), F.max("o_number").alias("k_last"), F.min("o_prefix").alias("k_prefix"), F.max("o_prefix").alias("k_last_prefix"))
        .filter("k_number = k_last")
        .select("asset_id", "k_number", F.when(F.col("k_prefix") == F.col("k_last_prefix"), F.col("k_prefix")).alias("k_prefix"))
    )
    # the anchor's own tag goes first, number and prefix together
    return (
        anchor.join(known, "asset_id", "left")
        .withColumn("t_prefix", F.when(F.col("t_number").isNull() & F.col("k_number").isNotNull(), F.col("k_prefix")).otherwise(F.col("t_prefix")))
        .withColumn("t_number", F.coalesce("t_number", "k_number"))
        .drop("k_number", "k_prefix")
    )


def link(placed: DataFrame, obs: DataFrame, least: float = 0.1) -> DataFrame:
    """``(obs_id, asset_id, confidence)`` of all pairs whose posterior is at least ``least``.

    The first model judges the candidates and gives each asset its anchor.  All observations of the anchor's thing are
    paired with the asset, every such pair votes for itself, and the second model, which knows one more function
    (how the pair belongs to the anchor's thing: by place, by id, by both or not at all), decides.
    """
    voted = durable(votes(candidates(placed, obs)))
    counts = pattern_counts(voted, VOTES)
    first = LabelModel(counts) if counts else None
    scored = confident(voted, VOTES, {p: first.posterior(p) for p in counts})
    # tags are used again along a street: a tag without a station anchors an asset with chainage only if nothing else contradicts, and after those with one
    unplaced = F.col("a_station").isNotNull() & F.col("o_station").isNull()
    sure = scored.filter((F.col("confidence") >= least) & consistent() & (~unplaced | ((F.col("v_kind") == 2) & (F.col("v_lateral") >= 0) & (F.col("v_rim") >= 0))))
    strength = F.struct((~unplaced).alias("p"), "confidence", (F.col("v_tag") + F.col("v_lateral") + F.col("v_rim") + F.col("v_kind") + F.col("v_station")).alias("s"), (-F.coalesce(F.abs(F.col("a_station") - F.col("o_station")), F.lit(0.0))).alias("d"), (-F.col("obs_id")).alias("o"))
    own = ["a_station", "a_lateral", "a_kind", "a_number", "a_prefix", "a_rim", "exact"]
    payload = F.struct("plan_id", "base", "suffix", "o_station", "o_lateral", F.coalesce("o_kind", "a_kind").alias("kind"), F.coalesce("o_number", "a_number").alias("number"), F.coalesce("o_prefix", F.when(F.col("o_number").isNull(), F.col("a_prefix"))).alias("prefix"), "o_rim", *own)
    anchor = (
        sure.groupBy("asset_id")
        .agg(F.max_by(payload, strength).alias("t"))
        .select("asset_id", *[F.col(f"t.{c}").alias(f"t_{c}") for c in ("plan_id", "base", "suffix", "o_station", "o_lateral", "kind", "number", "prefix", "o_rim", "a_station", "a_lateral")], *[f"t.{c}" for c in own])
    )
    anchor = durable(with_known_tags(durable(anchor), sure))
    pairs = durable(votes(things(anchor, obs)).select("obs_id", "asset_id", *VOTES, "v_thing", "was_candidate"))
    every = [*VOTES, "v_thing"]
    seen = pattern_counts(pairs.filter("was_candidate"), VOTES)
    patterns = pattern_counts(pairs, every)
    # candidates that belong to no thing are the other class's share of the evidence
    for p, n in counts.items():
        left = n - seen.get(p, 0)
        if left > 0:
            patterns[*p, -1] = patterns.get((*p, -1), 0) + left
    second = LabelModel(patterns, start=lambda p: 0.95 if p[-1] > 0 else 0.05) if patterns else None
    judged = confident(pairs, every, {p: second.posterior(p) for p in patterns})
    return judged.groupBy("obs_id", "asset_id").agg(F.max("confidence").alias("confidence")).filter(F.col("confidence") >= least)


def things(anchor: DataFrame, obs: DataFrame) -> DataFrame:
    """Pairs of each asset with the observations of its anchor's thing, with ``v_thing``: 1 by id, 2 by place, 3 by both.

    A pair found both ways comes once.  ``was_candidate`` tells whether the blocks had the pair as well.
    """
    same_kind = F.col("o_kind").isNull() | F.col("t_kind").isNull() | (F.col("o_kind") == F.col("t_kind"))
    side = F.coalesce("t_o_lateral", "t_a_lateral")
    same_side = side.isNull() | F.col("o_lateral").isNull() | (F.abs(side - F.col("o_lateral")) <= 1.3)
    # one reading of a thing on the wrong side of the line: everything else is the same
    same_tag = F.coalesce((F.col("o_number") == F.col("t_number")) & (F.col("o_prefix") == F.col("t_prefix")), F.lit(False))
    same_reading = F.coalesce((F.abs(F.col("o_rim") - F.col("t_o_rim")) < 0.005) & (F.abs(F.col("o_station") - F.col("t_o_station")) < 0.01) & (F.abs(side + F.col("o_lateral")) < 0.05), F.lit(False))
    same_side = same_side | same_tag | same_reading
    both_tags = F.col("o_number").isNotNull() & F.col("t_number").isNotNull()
    prefix_ok = F.col("o_prefix").isNull() | F.col("t_prefix").isNull() | (F.col("o_prefix") == F.col("t_prefix"))
    not_other = ~both_tags | ((F.col("o_number") == F.col("t_number")) & prefix_ok)
    street = (F.col("base") == F.col("t_base")) & (F.col("suffix") == F.col("t_suffix")) & (F.col("plan_id") == F.col("t_plan_id"))
    apart = F.abs(F.col("o_station") - F.col("t_o_station"))
    at_place = F.coalesce((apart <= 2) & same_kind & same_side & not_other, F.lit(False))
    # by id, where the observation or the anchor has no position; the asset's own still holds
    in_reach = F.col("t_o_station").isNotNull() | F.coalesce(F.abs(F.col("o_station") - F.col("t_a_station")) <= REACH, F.lit(True))
    by_tag = (F.col("o_number") == F.col("t_number")) & prefix_ok & (F.col("o_station").isNull() | F.col("t_o_station").isNull() | (apart <= 4)) & in_reach & same_kind & same_side
    by_tag = F.coalesce(by_tag, F.lit(False))
    stretch = anchor.filter("t_o_station is not null").withColumn("t_bucket", F.explode(F.array_distinct(F.array(F.floor((F.col("t_o_station") - 2) / BUCKET), F.floor((F.col("t_o_station") + 2) / BUCKET)))))
    placed = obs.filter("o_station is not null").withColumn("bucket", F.floor(F.col("o_station") / BUCKET))
    near = placed.join(stretch, street & (F.col("bucket") == F.col("t_bucket")) & at_place).withColumn("v_thing", F.when(by_tag, 3).otherwise(2))
    named = obs.filter("o_number is not null").join(anchor.filter("t_number is not null"), street & by_tag & (F.col("o_number") == F.col("t_number")) & ~at_place).withColumn("v_thing", F.lit(1))
    distance = F.abs(F.col("a_station") - F.col("o_station"))
    was = F.coalesce(distance <= REACH, F.coalesce(F.col("a_number") == F.col("o_number"), F.lit(False)))
    return near.drop("bucket", "t_bucket").unionByName(named).withColumn("was_candidate", was)


def plan_set_links(structures: DataFrame, tiles: DataFrame, assets: DataFrame, canon: DataFrame, units_ref: DataFrame | None = None) -> DataFrame:
    """Links of structure observations and surveyed assets."""
    kind_of = code_of(canon, "structure_type")
    obs = durable(observation_features(structures, tiles, kind_of, factors(units_ref)))
    named = assets.filter("street_name is not null")
    streets = match_streets(obs.select("base", "suffix").distinct(), named.select(F.col("street_name").alias("name")).distinct())
    placed = asset_features(named, kind_of).join(streets, "name").select("asset_id", "a_station", "a_lateral", "a_kind", "a_number", "a_prefix", "a_rim", "base", "suffix", "exact")
    return link(durable(placed), obs)
