"""Numbers and unit expressions: a grammar for both, dimensions as exponent vectors, canonical units.

A unit is ``(exponents, scale, offset)`` over the base dimensions ``BASE``: a value ``v`` of the unit is
``v * scale + offset`` in base units (feet).  A unit expression is a product or quotient of units,
numbers and powers (``in/ft``, ``ft per 100 ft``, ``ft^2``): a fold over its words adds exponents and
multiplies scales, so ``in/ft`` has exponents (0,) and scale 1/12, which is a slope, and ``in*ft``
has (2,), which is none.  All parsing is done by native column expressions built from the lexicon.
"""

from __future__ import annotations

from functools import cache
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

FOOT_M = 0.3048
BASE = ("length",)

#: Spellings of length units. code -> (exponents, scale to feet, offset, spellings)
LENGTH_UNITS = {
    "ft": ((1,), 1.0, 0.0, ["ft", "feet", "foot", "lf", "'"]),
    "inch": ((1,), 1.0 / 12.0, 0.0, ["in", "ins", "inch", "inches", '"']),
    "yd": ((1,), 3.0, 0.0, ["yd", "yds", "yard", "yards"]),
    "m": ((1,), 1.0 / FOOT_M, 0.0, ["m", "mtr", "mtrs", "metre", "metres", "meter", "meters", "metric"]),
    "cm": ((1,), 0.01 / FOOT_M, 0.0, ["cm", "cms", "centimetre", "centimetres", "centimeter", "centimeters"]),
    "mm": ((1,), 0.001 / FOOT_M, 0.0, ["mm", "mms", "millimetre", "millimetres", "millimeter", "millimeters", "dn"]),
    "km": ((1,), 1000.0 / FOOT_M, 0.0, ["km", "kms", "kilometre", "kilometres", "kilometer", "kilometers"]),
}

#: Codes of pipe sizes, whose common unit is the inch; a unit without one keeps its own code.
SIZE_CODE = {"ft": "size_ft", "inch": "size_inch", "m": "size_m", "cm": "size_cm", "mm": "size_mm"}

#: Dimensionless units that have a code of their own: code -> scale.
SLOPE_SCALE = {"frac": 1.0, "pct": 0.01, "permil": 0.001, "in_per_ft": 1.0 / 12.0}

#: Names of slope units that no unit expression gives (lower case, no dots).
SLOPE_WORDS = {
    "frac": ["decimal", "dec", "frac", "fraction", "rise over run", "rise/run"],
    "pct": ["percent", "per cent", "pct", "% grade", "% slope", "percent grade"],
    "permil": ["o/oo", "0/00", "per mil", "per mille", "permil", "permille", "per thousand", "per 1000"],
    "one_in_n": ["1:n", "1 in n", "1 on n", "n:1", "run per 1 rise", "run per rise", "run to one", "run to 1", "run over rise", "run/rise", "h:v", "1 v:n h"],
}

#: Words that stand beside a number without being a unit.
NOT_A_UNIT = (
    "sta station stations lt rt l r left right cl gb ltgb rtgb offset o s dia diam diameter id od nominal nom x by pipe pipes of to on at "
    "rcp pvc hdpe vcp dip cmp acp stl cop class cl sdr n e w existing ex new"
).split()


def _literal(value) -> str:
    if isinstance(value, (tuple, list)):
        return f"array({', '.join(map(_literal, value))})"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value!r}D" if isinstance(value, float) else str(value).lower()


@cache
def _map_sql(pairs: tuple) -> str:
    return f"map({', '.join(_literal(x) for x in chain.from_iterable(pairs))})"


def _map(pairs: dict[str, object]) -> Column:
    """A map of constants; written as one SQL text, since a column object for each entry is slow to build."""
    return F.expr(_map_sql(tuple(pairs.items())))


def _length_sql() -> str:
    return _map_sql(tuple((word, code) for code, (*_, words) in LENGTH_UNITS.items() for word in words))


#: Foot and inch marks and their plain forms.
_MARKS = ("′’‘´`ʹ″”“ʺ", "'" * 6 + '"' * 4)


def plain_marks(text: Column) -> Column:
    """Lower case; all foot and inch marks as ' and "; a doubled foot mark is an inch mark."""
    return F.replace(F.translate(F.lower(text), *_MARKS), F.lit("''"), F.lit('"'))


# ------------------------------------------------------------------------------ numbers
#
# The grammar is written as SQL text, named after the column it reads: one text is quickly built and parsed,
# thousands of column objects are not.


def let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to a value that is evaluated once, however often ``body`` names it."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def plain_sql(text: str) -> str:
    return f"replace(translate(lower({text}), {_literal(_MARKS[0])}, {_literal(_MARKS[1])}), {_literal(2 * chr(39))}, {_literal(chr(34))})"


_FRACTION = r"\d+ ?/ ?\d+"
_FEET_INCHES = rf"\d++(?:\.\d++)?\s*+(?:'|ft\b\.?|feet\b|foot\b)\s*-?\s*(?:(?:\d+[ -]+)?{_FRACTION}|\d+(?:\.\d+)?)\s*(?:\"|in\b|inch)"
_PLAIN = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?(?!\d)|\d+,\d{1,2}(?![\d.,])|\d+(?:\.\d+)?(?:e[-+]?\d+)?|\.\d+"
#: Longest form first; the leftmost number of a text is taken.  A minus counts at the start of a word only.
_NUMBER = rf"(?:(?<![^\s(:=])[-−–] ?)?(?:{_FEET_INCHES}|(?:\d+[ -]+)?{_FRACTION}|{_PLAIN})"
#: What a text with more than a plain number shows: a fraction, a comma or exponent in a number, a minus, feet before inches.
_NOT_SIMPLE = r"/|\d[,e]|[-−–] ?[\d.]|['t]\.?\s*-?\s*\d"


def _double(text: Column) -> Column:
    return F.nullif(text, F.lit("")).try_cast("double")


def _part_of(text: str, pattern: str, group: int) -> str:
    return f"try_cast(nullif(regexp_extract({text}, {_literal(pattern)}, {group}), '') as double)"


def _with_fraction(text: str) -> str:
    """``3/4`` and ``1 1/2``; else a plain number: thousands commas are dropped, a decimal comma becomes a point."""
    over = r"^(?:(\d+)[ -]+)?(\d+) ?/ ?(\d+)$"
    fraction = f"coalesce({_part_of(text, over, 1)}, 0D) + {_part_of(text, over, 2)} / nullif({_part_of(text, over, 3)}, 0D)"
    decimal = f"regexp_replace({text}, {_literal('^([0-9]+),([0-9]{1,2})$')}, '$1.$2')"
    return f"case when contains({text}, '/') then {fraction} else try_cast(replace({decimal}, ',', '') as double) end"


def number_sql(plain: str) -> str:
    """``number_of`` a text whose marks are plain already."""
    feet = r"^(\d+(?:\.\d+)?)\s*(?:'|f[a-z]+\.?)\s*-?\s*([\d./ -]*\d)\s*(?:\"|in)"
    inches = let(f"regexp_extract(v, {_literal(feet)}, 2)", "i", _with_fraction("i"))
    value = f"coalesce(try_cast(v as double), case when contains(v, {_literal(chr(39))}) or contains(v, 'f') then {_part_of('v', feet, 1)} + {inches} / 12D else {_with_fraction('v')} end)"
    unsigned = let("regexp_replace(m, '^[-−–] ?', '')", "v", value)
    full = let(f"regexp_extract({plain}, {_literal(_NUMBER)}, 0)", "m", f"{unsigned} * if(m rlike '^[-−–]', -1, 1)")
    return f"case when {plain} rlike {_literal(_NOT_SIMPLE)} then {full} else {_part_of(plain, '[0-9]+(?:[.][0-9]+)?|[.][0-9]+', 0)} end"


def number_of(text: str) -> Column:
    """First number of a text column, with sign; null if there is none.

    Read are thousands commas, a decimal comma before one or two digits, exponents, fractions, mixed numbers, and
    feet with inches, which are given in feet.
    """
    return F.expr(let(plain_sql(text), "t", number_sql("t")))


def station_sql(plain: str) -> str:
    plus = r"(\d{1,4})\s*\+\s*(\d{1,3}(?:\.\d+)?)"
    return f"coalesce(case when contains({plain}, '+') then {_part_of(plain, plus, 1)} * 100D + {_part_of(plain, plus, 2)} end, {number_sql(plain)})"


def station_number(text: str) -> Column:
    """Plus-notation is hundreds of the unit; otherwise the first number."""
    return F.expr(let(plain_sql(text), "t", station_sql("t")))


def side_sql(text: str) -> str:
    """1 right or on the centre line, -1 left, null if no side is named."""
    apart, glued = r"(?<![A-Z])(LEFT|RIGHT|LT|RT|L|R|CL)(?:GB)?(?![A-Z])", r"(LT|RT)(?:GB)?(?![A-Z])"
    named = let(f"regexp_extract(w, {_literal(apart)}, 1)", "a", f"case when a <> '' then a else regexp_extract(w, {_literal(glued)}, 1) end")
    return let(let(f"upper({text})", "w", named), "s", "case when startswith(s, 'L') then -1 when s <> '' then 1 end")


def signed_sql(plain: str) -> str:
    return let(f"struct({side_sql(plain)} as side, {number_sql(plain)} as n)", "z", "case when z.side is not null then abs(z.n) * z.side else z.n end")


def signed_number(text: str) -> Column:
    """First number of a text; where a side is named it gives the sign."""
    return F.expr(let(plain_sql(text), "t", signed_sql("t")))


# ------------------------------------------------------------------------------ units


def length_unit_sql(plain: str) -> str:
    words = _literal("([a-z]+|['\"])")
    return f"get(filter(transform(regexp_extract_all({plain}, {words}, 1), w -> {_length_sql()}[w]), u -> u is not null), 0)"


def length_unit_of(text: str) -> Column:
    """Code of the first length unit among the words and marks of a text; null if there is none."""
    return F.expr(let(plain_sql(text), "t", length_unit_sql("t")))


def unknown_unit_sql(plain: str) -> str:
    """The word after the first number that is neither a unit nor known to be none; else null."""
    known = _map_sql(tuple((w, True) for w in sorted({w for *_, ws in LENGTH_UNITS.values() for w in ws} | set(NOT_A_UNIT))))
    return let(f"regexp_extract({plain}, {_literal('[0-9][ ]*([a-z]{2,})(?![a-z])')}, 1)", "w", f"case when w <> '' and {known}[w] is null then w end")


def length_scale(code: Column) -> Column:
    """Feet per unit."""
    return _map({c: s for c, (_, s, _, _) in LENGTH_UNITS.items()})[code]


def unit_expression_sql(plain: str) -> str:
    """``struct(exponents, scale, sound, ...)`` of a unit expression: a fold over its words.

    ``/`` and ``per`` put all that follows below the line, until a ``*``; ``^n`` and raised digits repeat the
    unit before them; a word that is no unit makes the expression unsound.
    """
    none = (0,) * len(BASE)
    lexicon = {w: (e, s) for e, s, _, ws in LENGTH_UNITS.values() for w in ws} | {w: (none, 0.01) for w in ("%", "percent", "pct")} | {"‰": (none, 0.001)}
    vectors = _map_sql(tuple((w, e) for w, (e, _) in lexicon.items()))
    scales = _map_sql(tuple((w, s) for w, (_, s) in lexicon.items()))
    words = f"regexp_extract_all({plain}, {_literal(r'([a-z]+|\^-?\d+|\d+(?:\.\d+)?|[^\s])')}, 1)"
    zero = _literal(none)

    def state(vector="a.vector", scale="a.scale", sign="a.sign", last=zero, last_scale="1D", sound="a.sound", units="a.units") -> str:
        return f"named_struct('vector', {vector}, 'scale', {scale}, 'sign', {sign}, 'last', {last}, 'last_scale', {last_scale}, 'sound', {sound}, 'units', {units})"

    power = let("case when w = '²' then 2 when w = '³' then 3 else try_cast(nullif(regexp_extract(w, '^\\\\^(-?[0-9]{1,2})$', 1), '') as int) end", "p", "(p - 1) * a.sign")
    plus = "zip_with(a.vector, {0}, (x, y) -> x + y * {1})".format
    step = (
        f"case when w in ('/', 'per', 'over') then {state(sign='-1')} when w in ('*', '·', '×') then {state(sign='1')} "
        f"when w in ('²', '³') or startswith(w, '^') then {state(plus('a.last', f'coalesce({power}, 0)'), f'a.scale * pow(a.last_scale, coalesce({power}, 0))', sound=f'a.sound and {power} is not null')} "
        f"when w rlike '^[0-9]' then {state(scale='a.scale * pow(coalesce(nullif(try_cast(w as double), 0D), 1D), a.sign)')} "
        f"when {vectors}[w] is not null then {state(plus(f'{vectors}[w]', 'a.sign'), f'a.scale * pow({scales}[w], a.sign)', last=f'{vectors}[w]', last_scale=f'{scales}[w]', units='a.units + 1')} "
        f"else {state(sound='false')} end"
    )
    return f"aggregate({words}, {state(zero, '1D', '1', zero, '1D', 'true', '0')}, (a, w) -> {step})"


def slope_unit_of(text: str) -> Column:
    """``struct(code, scale)`` of a slope unit: a known name or a dimensionless expression; else null.

    An expression that equals no unit with a code has a null code and its own scale.
    """
    names = _map_sql(tuple((w, code) for code, ws in SLOPE_WORDS.items() for w in ws))
    by_scale = " ".join(f"when abs(s / {_literal(v)} - 1) < 1e-9 then {_literal(code)}" for code, v in SLOPE_SCALE.items())
    coded = f"case when s is not null then named_struct('code', case {by_scale} end, 'scale', s) end"
    ratio = let(unit_expression_sql("t"), "e", f"case when e.sound and e.units > 0 and e.vector = {_literal((0,) * len(BASE))} then e.scale end")
    named = let(f"{names}[t]", "c", f"case when c is not null then named_struct('code', c, 'scale', cast(null as double)) else {let(ratio, 's', coded)} end")
    # dots are of abbreviations here, and blanks are loose
    return F.expr(let(f"trim(regexp_replace(replace({plain_sql(text)}, '.', ''), {_literal(r'\s+')}, ' '))", "t", named))


# ------------------------------------------------- units that stand in notes, by quantity

#: Words naming the quantity a note speaks of.
QUANTITY_WORDS = {
    "station": r"(?:stations?|stationing|chainages?|sta)",
    "offset_txt": r"(?:offsets?|o/s)",
    "size": r"(?:sizes?|dias?|diameters?|nominal dia(?:meter)?s?)",
    "slope": r"(?:slopes?|grades?|gradients?|falls?|s)",
}
_LINK = r"(?:[\s./,&:=()-]|\band\b|\bor\b|\boffsets?\b|\bstation(?:s|ing)?\b|\bsta\b|\bvalues?\b|\bon this (?:tile|sheet)\b|\bare\b|\bis\b|\bread\b|\bgiven\b|\brecorded\b|\bshown\b|\bnoted\b|\ball\b|\bin\b|\bas\b)"
_LENGTH_WORD = "|".join(sorted((w for *_, ws in LENGTH_UNITS.values() for w in ws if w.isalpha() and w != "in"), key=len, reverse=True))
#: Slope units as phrases inside a note.
_SLOPE_NOTE = {
    "pct": r"(?:%|percent|per cent|pct)",
    "permil": r"(?:‰|o/oo|per (?:thousand|1000|mille?)|permille?)",
    "in_per_ft": r"(?:inch(?:es)? per f(?:oo|ee)t|in\.? per ft|in\.?/ft|\"/ft)",
    "one_in_n": r"(?:1 ?(?:in|on|:) ?n\b|run to (?:one|1)\b|run per (?:1 )?rise|run over rise)",
    "frac": r"(?:ft/ft|m/m|feet per foot|decimals?)",
}


def note_unit(note: Column, quantity: str) -> Column:
    """Unit code that a note states for a quantity, e.g. ``STATIONS IN METRES``; null if it states none.

    A number before the unit (``5 mm gasket``) or other words between quantity and unit make it
    a remark about something else.
    """
    text = plain_marks(note)
    name = rf"(?<![a-z0-9]){QUANTITY_WORDS[quantity]}(?![a-z0-9])"
    if quantity == "slope":
        return F.coalesce(*[F.when(text.rlike(name + rf"{_LINK}*(?<![a-z0-9]){unit}"), F.lit(code)) for code, unit in _SLOPE_NOTE.items()])
    word = F.regexp_extract(text, name + rf"{_LINK}*(?<![a-z])({_LENGTH_WORD}|inch|inches)(?![a-z])", 1)
    return F.expr(_length_sql())[F.nullif(word, F.lit(""))]
