"""Free-entered values mapped to a canonical list; what fits no entry is reported as ``none``.

A multi-pattern automaton over canonical codes, titles and aliases finds the mentions embedded in a
value; mentions must start and end at word boundaries, the longest non-overlapping ones win, and
the winning mention of the value is its longest that is not denied (``not PVC``).  Values without a
mention go to token-set similarity: the weighted share of a name's words, typing errors allowed, that the value has in
whatever order; and words broken or run together are compared by edit distance, all at one parameter,
``least_similarity``.

Abbreviations of up to ``WHOLE_ONLY`` letters (``red.``, ``C.O.``) are too short to be trusted inside a longer text; they
count if nothing but numbers and words of ``BESIDE`` stands with them (``RCP 24``).

The canonical list is a fixed register (bounded by ``MAX_ENTRIES``) that goes to every worker with
the function.  The mapping is a narrow stage: values are looked up per Arrow batch, each
distinct value once per worker, and nothing is shuffled, so hot values cost nothing.

Edge cases: null values give no row; blank values and values of punctuation only are ``none``; values that
are a code of the list, character for character, give no row in the report; very long values are
searched whole by the automaton; ties between equally long mentions go to the first, between equally
similar entries to the alias that sorts first.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from culvert.runtime import collect_bounded

MAX_ENTRIES = 10_000
NONE = "none"

#: Other names of the canonical entries.
ALIASES = {
    "structure_type": {
        "SDMH": "SDMH; SD MH; S.D.M.H.; SD manhole; storm manhole; storm MH; storm drain manhole; storm drain M.H.; stm drn manhole; drainage manhole; manhole storm; manhole storm drain; pozo de registro pluvial",
        "SSMH": "SSMH; SS MH; S.S.M.H.; SAN MH; sewer manhole; sewer MH; sanitary manhole; sanitary sewer manhole; san sewer M.H.; foul manhole; manhole sewer; manhole san; pozo de registro sanitario",
        "CB": "CB; C.B.; catch basin; catchbasin; catch bsn; storm catch basin; catch basin grate; gully pot; basin",
        "GB": "GB; G.B.; grade break; gradebreak; grade brk; grade brk pt; break in grade; grade break pt",
        "inlet": "inlet; DI; D.I.; drop inlet; curb inlet; side inlet; storm inlet; storm drain inlet; inlet type C; curb opening inlet",
        "cleanout": "cleanout; clean out; CO; C.O.; SSCO; sewer cleanout; sewer c/o; rodding eye",
        "junction": "junction; junction structure; junction box; jct; jct box; jct str.; jct structure; JB; J.B.",
        "gate_valve": "gate valve; GV; G.V.; gate vlv; water gate valve; valve gate",
        "fire_hydrant": "fire hydrant; hydrant; FH; F.H.; fire hyd.; hydrant assembly",
        "blow_off": "blow off; blowoff; BO; B.O.; blow off valve; blow off assembly",
        "air_valve": "air valve; ARV; AVRV; air vac; air release valve; air rel valve; combination air valve; valve air",
        "PRV": "PRV; P.R.V.; PRV station; pressure reducing valve; pressure regulating valve; press red valve; valve pressure reducing",
        "meter": "meter; WM; W.M.; water meter; wtr meter; meter box; mtr box; service meter",
        "tee": "tee; tee fitting; fitting tee; T-fitting; pipe tee; tee connection",
        "reducer": "reducer; reducer fitting; fitting reducer; pipe reducer; concentric reducer; red.",
        "bend": "bend; bend fitting; fitting bend; pipe bend; elbow; elbow/bend; bend 45; bend 90; 1/8 bend; 11.25 deg bend",
        "service_connection": "service connection; svc conn; svc connection; serv conn; service lateral connection; house connection; svc tap",
    },
    "callout_type": {
        "edge_of_pavement": "edge of pavement; EOP; E.P.; EP line; edge pvmt; edge of pvmt; pavement edge",
        "detail_reference": "detail reference; detail ref; det ref; dtl ref; detail callout; detail bubble",
        "cross_reference": "cross reference; cross ref; x ref; xref; sheet reference",
        "grading_note": "grading note; grade note; grd note; grdg note; grading; rough grading note",
        "installation_note": "installation note; installation; install note; instl note; inst note",
        "match_existing": "match existing; match exist; match ex; match (e); join existing; join ex",
        "cover_depth": "cover depth; depth of cover; cvr depth; min cover",
    },
    "material": {
        "RCP": "RCP; R.C.P.; reinforced concrete pipe; reinforced concrete; reinf conc pipe; RCP CL III",
        "PVC": "PVC; P.V.C.; polyvinyl chloride; poly vinyl chloride; PVC pipe; plastic (PVC)",
        "PVC_SDR26": "PVC SDR26; PVC SDR 26; SDR26; SDR 26; SDR 26 PVC; PVC (SDR 26); polyvinyl chloride SDR 26",
        "PVC_C900": "PVC C900; PVC C 900; C900; C 900 PVC; AWWA C900; C900 DR18; polyvinyl chloride C900",
        "DIP": "DIP; D.I.P.; ductile iron pipe; ductile iron; duct iron; CL350 DIP",
        "HDPE": "HDPE; H.D.P.E.; high density polyethylene; hi density polyethylene; HDPE pipe; PEAD",
        "VCP": "VCP; V.C.P.; vitrified clay pipe; vitrified clay; vit clay; clay pipe",
        "CMP": "CMP; C.M.P.; corrugated metal pipe; corrugated metal; corr metal pipe; corr mtl pipe",
        "ACP": "ACP; A.C.P.; asbestos cement pipe; asbestos cement; AC pipe; asb cem pipe",
        "STL": "STL; steel; steel pipe; STL pipe; welded steel pipe; welded steel; WSP; cement lined steel",
        "COP": "COP; copper; copper tube; Cu; copper type K; type K copper",
    },
}

#: Marks after a value that say existing, new, noted or doubtful.
_STATUS = re.compile(r"\s+[en]$")
_DENIED = re.compile(r"(?:^| )(?:not|non|isn t|without)(?: an?)?$")
_SIZED = re.compile(r"\d+(?:mm|cm|in|ft|m)?|dn\d+")


def plain(value: str) -> str:
    """Lower case without accents; everything but letters and digits is one blank."""
    text = unicodedata.normalize("NFKD", value).lower()
    return " ".join(re.findall(r"[^\W_]+", "".join(c for c in text if not unicodedata.combining(c))))


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions of neighbours; ``most + 1`` if it is more than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


class CanonicalMatcher:
    """Maps one value of one list to a canonical code."""

    WHOLE_ONLY = 3
    #: Words that may stand beside a short name without changing what it is.
    BESIDE = frozenset("pipe pipes class cl type typ dia diam diameter in inch inches ft mm cm m dn id od existing exist ex proposed prop new per std no nr".split())

    def __init__(self, entries: list[tuple[str, str]], aliases: dict[str, str], least_similarity: float = 0.8):
        import ahocorasick

        self.least = least_similarity
        self.names: dict[str, str] = {}
        for code, title in entries:
            for name in [code, title, *aliases.get(code, "").split(";")]:
                if name and plain(name):
                    self.names.setdefault(plain(name), code)
        self.squeezed: dict[str, str] = {}
        self.token_sets: dict[tuple, str] = {}
        self.grams: dict[str, set[str]] = defaultdict(set)
        self.automaton = ahocorasick.Automaton()
        for name, code in sorted(self.names.items()):
            self.squeezed.setdefault(name.replace(" ", ""), code)
            self.token_sets.setdefault(self._token_set(name), code)
            if len(name.replace(" ", "")) > self.WHOLE_ONLY:
                self.automaton.add_word(f" {name} ", (len(name) + 2, code))
        for name in self.names:
            for form in self._orders(name):
                for g in self._bigrams(form.replace(" ", "")):
                    self.grams[g].add(form)
        self.longest = max((len(f) for f in self.squeezed), default=0)
        # names of two words and more, by the set of their words; rarer words weigh more
        self.word_sets: dict[tuple, str] = {}
        for name, code in sorted(self.names.items()):
            key = tuple(sorted(set(name.split())))
            if len(key) >= 2 and all(len(w) >= 3 for w in key):
                self.word_sets.setdefault(key, code)
        self.holders: dict[str, list[tuple]] = defaultdict(list)
        self.word_grams: dict[str, set[str]] = defaultdict(set)
        for key in self.word_sets:
            for w in key:
                self.holders[w].append(key)
                for g in self._bigrams(w):
                    self.word_grams[g].add(w)
        self.weight = {w: math.log(1 + len(self.word_sets) / len(keys)) for w, keys in self.holders.items()}
        self.form_code = {f: c for n, c in self.names.items() for f in reversed(self._orders(n))}
        self.automaton.make_automaton()
        self.known: dict[str, str] = {}

    @staticmethod
    def _token_set(name: str) -> tuple:
        return tuple(sorted(set(re.findall(r"[a-z]+|[0-9]+", name))))

    @staticmethod
    def _orders(name: str) -> list[str]:
        """A name and its words in sorted order; initials keep their order, as they are other names in another."""
        words = name.split()
        return [name] if any(len(w) == 1 for w in words) else [name, " ".join(sorted(words))]

    @staticmethod
    def _bigrams(text: str) -> set[str]:
        return {text[i : i + 2] for i in range(len(text) - 1)}

    def __call__(self, value: str) -> str:
        code = self.known.get(value)
        if code is None:
            code = self._find(value)
            if len(self.known) < 200_000:
                self.known[value] = code
        return code

    def _find(self, value: str) -> str:
        return self.stage_of(value)[1]

    def stage_of(self, value: str) -> tuple[str, str]:
        """The stage that decides (exact, mention, tokens, edits or none) and the code it gives."""
        name = plain(value)
        while name:
            for stage, find in (("exact", self._exact), ("mention", self._mention), ("mention", self._short), ("tokens", self._tokens), ("edits", self._edits)):
                code = find(name)
                if code:
                    return stage, code
            shorter = _STATUS.sub("", name)
            if shorter == name:
                break
            name = shorter
        return "none", NONE

    def _exact(self, name: str) -> str | None:
        return self.names.get(name) or self.squeezed.get(name.replace(" ", "")) or self.token_sets.get(self._token_set(name))

    def _mention(self, name: str) -> str | None:
        text = f" {name} "
        found = sorted(((end + 1 - n, end, code) for end, (n, code) in self.automaton.iter(text)), key=lambda m: (m[0] - m[1], m[0]))
        taken: list[tuple[int, int, str]] = []
        for start, end, code in found:  # longest first; neighbours share the blank between them
            if all(end <= s or start >= e for s, e, _ in taken):
                taken.append((start, end, code))
        return next((code for start, _, code in taken if not _DENIED.search(text[max(0, start - 12) : start])), None)

    def _short(self, name: str) -> str | None:
        """A short name that stands beside numbers and words without a meaning of their own."""
        words = [w for w in name.split() if not (w in self.BESIDE or w.isdigit() or _SIZED.fullmatch(w))]
        return self.names.get(" ".join(words)) if words and len(words) < len(name.split()) else None

    def _tokens(self, name: str) -> str | None:
        """Token-set similarity: the weighted share of a name's words that the value has, words with typing errors included.

        Names of two words and more are looked up by an inverted index of their words; a word counts for at least
        ``least`` of its length.  The order and number of the value's other words do not matter.
        """
        words = set(name.split())
        if "not" in words or "non" in words:
            return None
        alike: dict[str, float] = {}
        for w in words:
            near = {t for g in self._bigrams(w) for t in self.word_grams.get(g, ())} if len(w) >= 5 else ({w} & self.weight.keys())
            for t in near:
                most = int((1 - self.least) * max(len(t), len(w)) + 1e-9)
                d = 0 if t == w else edits(w, t, most)
                if d <= most:
                    alike[t] = max(alike.get(t, 0.0), 1 - d / max(len(t), len(w)))
        best: tuple | None = None
        for key in {k for t in alike for k in self.holders[t]}:
            score = sum(self.weight[t] * alike.get(t, 0.0) for t in key) / sum(self.weight[t] for t in key)
            rank = (-score, -len(key), key)
            if score >= self.least and all(t in alike for t in key) and (best is None or rank < best):
                best = rank
        return self.word_sets[best[2]] if best else None

    def _edits(self, name: str) -> str | None:
        """Similarity of the words run together, in the given and in sorted order: for words broken or joined by an error."""
        bare = _STATUS.sub("", name)
        best: tuple | None = None
        for form in self._orders(bare):
            flat = form.replace(" ", "")
            if len(flat) * self.least > self.longest:
                continue  # too long to be similar to any name
            votes: dict[str, int] = defaultdict(int)
            for g in self._bigrams(flat):
                for c in self.grams.get(g, ()):
                    votes[c] += 1
            for cand, n in votes.items():
                target = cand.replace(" ", "")
                most = 2 if len(target) >= 12 else 1
                if abs(len(target) - len(flat)) > most or n < len(flat) - 1 - 3 * most - 1:
                    continue
                d = edits(flat, target, most)
                if d <= most and 1 - d / max(len(flat), len(target)) >= self.least and (best is None or (d, cand) < best[:2]):
                    best = (d, cand, self.form_code[cand])
        return best[2] if best else None


def map_values(values: DataFrame, canon: DataFrame, keep_value: bool = False) -> DataFrame:
    """``(record_kind, record_id, canon_code)``, and the value if it is to be kept, of rows ``(record_kind, record_id, list_name, value)``."""
    register = collect_bounded(canon.filter("canon_code is not null").select("list_name", "canon_code", "title").orderBy("list_name", "canon_code"), MAX_ENTRIES, "canonical list")
    register = [tuple(r) for r in register]
    exact = {(a, b) for a, b, _ in register}
    lists = sorted({a for a, _, _ in register})
    inexact = reduce(
        lambda a, b: a | b,
        [(F.col("list_name") == n) & ~F.col("value").isin([c for m, c in exact if m == n]) for n in lists],
        ~F.col("list_name").isin(lists),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_list: dict[str, list] = defaultdict(list)
        for n, code, title in register:
            by_list[n].append((code, title))
        match = {n: CanonicalMatcher(entries, ALIASES.get(n, {})) for n, entries in by_list.items()}
        for batch in batches:
            codes = [match[n](v) if n in match else NONE for n, v in zip(batch["list_name"], batch["value"])]
            out = {"record_kind": batch["record_kind"], "record_id": batch["record_id"], "canon_code": codes}
            yield pd.DataFrame({**out, "value": batch["value"]} if keep_value else out)

    kept = values.filter("value is not null").filter(inexact).select("record_kind", "record_id", "list_name", "value")
    return kept.mapInPandas(run, "record_kind string, record_id bigint, canon_code string" + (", value string" if keep_value else ""))


def code_of(canon: DataFrame, list_name: str):
    """A vectorised function from a free-entered value to its canonical code of one list; null where there is none."""
    rows = collect_bounded(canon.filter(F.col("canon_code").isNotNull() & (F.col("list_name") == list_name)).select("canon_code", "title").orderBy("canon_code"), MAX_ENTRIES, "canonical list")
    entries = [tuple(r) for r in rows]

    @F.pandas_udf("string")
    def codes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        match = CanonicalMatcher(entries, ALIASES.get(list_name, {}))
        for batch in batches:
            found = [None if v is None else match(v) for v in batch]
            yield pd.Series([None if c == NONE else c for c in found], dtype=object)

    return codes


def typed_values(structures: DataFrame, callouts: DataFrame, pipes: DataFrame) -> DataFrame:
    """The three free-entered fields as one relation."""

    def part(df: DataFrame, kind: str, key: str, field: str, lists: str) -> DataFrame:
        return df.select(F.lit(kind).alias("record_kind"), F.col(key).alias("record_id"), F.lit(lists).alias("list_name"), F.col(field).alias("value"))

    return (
        part(structures, "structure", "obs_id", "structure_type", "structure_type")
        .unionByName(part(callouts, "callout", "callout_id", "callout_type", "callout_type"))
        .unionByName(part(pipes, "pipe", "pipe_id", "material", "material"))
    )
