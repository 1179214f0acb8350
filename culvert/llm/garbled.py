"""Text decoded with the wrong character encoding: found, and restored where possible.

For UTF-8 and each of 14 wrong encodings the garbled form of every tabled character is computed
beforehand; a multi-pattern automaton finds these forms in a text, and only the matched spans
are replaced, so correct text around them stays untouched.  Text garbled several times is
restored by repeating the pass until nothing is found.  Characters above the kana (CJK ideographs) are part of the
table as well, for the encodings in which they occur.

Pairs of two single-byte encodings (Windows Cyrillic read as Western, KOI8 read as Windows Cyrillic, ...)
garble one character into one character that may be legitimate on its own; they are found by the
shape of the words they produce and only their words are restored.  Cyrillic encodings read as each other
are tried pair by pair from the byte tables; two unlikely words at least must become likely Russian ones.

A replacement character (U+FFFD) proves a wrong decoding but cannot be undone: the document
is found, the character stays.

Edge cases: null, empty and pure ASCII texts are never affected and are skipped before any Python
runs; very long texts are searched whole; repeated documents are judged each for itself;
an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Wrong encodings that UTF-8 is commonly read as, in order of preference.
WRONG_FOR_UTF8 = ["cp1252", "latin_1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "iso8859_2", "iso8859_15", "cp866", "koi8_r", "cp1253", "cp1254", "cp1257"]
#: Ideographs, kana and emoji are tabled for these only.
WIDE = WRONG_FOR_UTF8[:6]
#: Ranges of characters that occur in texts.
NARROW_RANGES = [(0xA0, 0x17F), (0x192, 0x192), (0x2C6, 0x2DD), (0x386, 0x3CE), (0x401, 0x45F), (0x490, 0x491), (0x2010, 0x205F), (0x20AC, 0x20AC), (0x2103, 0x2126), (0x2150, 0x215E), (0x2190, 0x21FF), (0x2200, 0x22FF), (0x2300, 0x2311), (0x2500, 0x25FF), (0x2600, 0x27BF), (0xFB01, 0xFB02), (0xFEFF, 0xFEFF), (0xFFFD, 0xFFFD)]
WIDE_RANGES = [(0x3000, 0x30FF), (0x4E00, 0x9FFF), (0xFF01, 0xFFE6), (0x1F300, 0x1F6FF), (0x1F900, 0x1F9FF)]

#: Marks that may close a word in capitals, as in a quoted name; one of them after a capital proves nothing alone.
CLOSING = set("”’“‘»«›‹…™®©ºª°–—·.,;:!?†‡ \u00a0")


@cache
def byte_table(encoding: str) -> list[str]:
    """Character of each byte; bytes the encoding leaves undefined keep their number, as decoders do."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


def garbled_forms() -> dict[str, tuple[str, str]]:
    """Garbled form -> (right character, wrong encoding)."""
    forms: dict[str, tuple[str, str]] = {}
    for enc in WRONG_FOR_UTF8:
        table = byte_table(enc)
        # the controls stand for bytes that a decoder could not read, in text garbled more than once
        for low, high in NARROW_RANGES + (WIDE_RANGES if enc in WIDE else []) + ([(0x80, 0x9F)] if enc in WRONG_FOR_UTF8[:2] else []):
            for code in range(low, high + 1):
                form = "".join(table[b] for b in chr(code).encode("utf-8"))
                forms.setdefault(form, (chr(code), enc))
    return forms


class SpanRepair:
    """Multi-pattern automaton over the garbled forms."""

    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for form, (char, enc) in garbled_forms().items():
            self.automaton.add_word(form, (form, char, enc))
        self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, str, str]]:
        """Longest matches from the left, without those that correct text may contain."""
        found = [(end + 1 - len(form), end + 1, char, enc) for end, (form, char, enc) in self.automaton.iter(text)]
        found.sort(key=lambda m: (m[0], -m[1]))
        taken: list[tuple[int, int, str, str]] = []
        for m in found:
            if not taken or m[0] >= taken[-1][1]:
                taken.append(m)
        starts, ends = {m[0] for m in taken}, {m[1] for m in taken}
        proof = [self._proves(text, m, starts, ends) for m in taken]
        # two proofs of one wrong encoding make its weaker matches credible as well
        proven = Counter(m[3] for m, p in zip(taken, proof) if p)
        return [m for m, p in zip(taken, proof) if p or proven[m[3]] >= 2]

    @staticmethod
    def _proves(text: str, m: tuple[int, int, str, str], starts: set[int], ends: set[int]) -> bool:
        """Whether a match cannot well be correct text; most matches cannot, the exceptions are listed."""
        start, end, char, enc = m
        form, before, after = text[start:end], text[start - 1 : start] if start else "", text[end : end + 1]
        lead, tail = form[0], form[1:]
        joined = start in ends or end in starts
        if "\u0400" <= lead <= "\u04ff":  # Cyrillic letters with marks or foreign letters after them
            foreign = not all(c in CLOSING or c in "№" or re.match("[А-яЁё]", c) for c in tail)
            return joined or (foreign and (len(form) > 2 or not re.match("[А-яЁё]", before)))
        if len(form) > 2:
            return True
        if "\u2500" <= lead <= "\u257f" and "\u2500" <= tail <= "\u257f":  # drawn tables stand apart from words
            return joined or before.isalnum() or after.isalnum()
        if lead == "√":
            return not tail.isspace()
        if tail in CLOSING and not tail.isspace() and before.isalpha() and before.isupper() and not after.isalpha():
            return joined  # a quoted word in capitals may end so
        return True

    def once(self, text: str) -> tuple[str, list[str]]:
        out, at, used = [], 0, []
        for start, end, char, enc in self.spans(text):
            out += [text[at:start], char]
            at = end
            used.append(enc)
        return ("".join([*out, text[at:]]) if used else text), used


def _recode(text: str, wrong: str, right: str) -> str | None:
    """Bytes of a text in the wrong encoding, decoded with the right one; None if that is impossible."""
    try:
        return bytes(_bytes_of(wrong)[c] for c in text).decode(right)
    except (KeyError, UnicodeDecodeError):
        return None


@cache
def _span_repair() -> SpanRepair:
    """One automaton per Python worker."""
    return SpanRepair()


@cache
def _bytes_of(encoding: str) -> dict[str, int]:
    back = {chr(b): b for b in range(256)}
    return back | {c: b for b, c in reversed(list(enumerate(byte_table(encoding))))}


def _western(low: int, high: int) -> str:
    """Regex class body of the cp1252 characters of a range of bytes, undefined ones included."""
    chars = {c for b in range(low, high + 1) for c in (byte_table("cp1252")[b], chr(b))}
    return "".join(re.escape(c) for c in sorted(chars))


_C1 = re.compile("[\x80-\x9f]+")
_WESTERN_RUN = re.compile("(?<![A-Za-z])[\u00c0-\u00ff\u00a8\u00b8]{3,}(?![A-Za-z])")
_WESTERN_WORD = re.compile("(?<![A-Za-z])[\u00c0-\u00ff\u00a8\u00b8]+(?![A-Za-z])")
_SJIS_LEAD, _SJIS_TRAIL = _western(0x81, 0x9F) + _western(0xE0, 0xEF), _western(0x40, 0x7E) + _western(0x80, 0xFC)
_SJIS = re.compile(f"(?:[{_western(0x81, 0x83)}][{_SJIS_TRAIL}]){{2,}}")
_SJIS_SPAN = re.compile(f"(?:[{_SJIS_LEAD}][{_SJIS_TRAIL}])+")
_UTF8_AS_WESTERN = re.compile(f"[{_western(0xC2, 0xDF)}][{_western(0x80, 0xBF)}]|[{_western(0xE0, 0xEF)}][{_western(0x80, 0xBF)}]{{2}}")
_EUC = re.compile("(?:[¡¤¥][\u00a1-\u00fe]){3,}")
_EUC_SPAN = re.compile("(?:[\u00a1-\u00fe][\u00a1-\u00fe])+")
_POLISH_WORD = re.compile("[^\\W\\d_]*[³¹¿¯£¥±¶¼¡¦¬\x80-\x9fœ\u0178Œ\u0161æêñÆÊÑ](?:[^\\W\\d_]|[³¹¿¯£¥±¶¼¡¦¬\x80-\x9f])*")
_POLISH_SURE = re.compile("[A-Za-z\u00c0-\u00ff][³¹¿±¶¼][a-z\u00e0-\u00ff]|[a-z][êæñ][a-z]*[³¹¿±¶¼](?![0-9])")
_KOI = re.compile("[а-яё]?[А-ЯЁ]*[а-яё][А-ЯЁ]{2,}[А-ЯЁа-яё]*")
_CYR_WORD = re.compile("[А-Яа-яЁё]+")
_CYR = "А-Яа-яЁёІіЅѕЈјҐґЇїЄєЎўЉљЊњЋћЌќЏџЂђЃѓ"
_MIXED = re.compile(f"(?<=[A-Za-z])[{_CYR}]{{1,3}}(?![{_CYR}])|(?<![{_CYR}])[{_CYR}]{{1,3}}(?=[a-z])|(?<=[0-9])[ЅјѕІ](?![{_CYR}])")
#: Signs that a western text loses to single letters; a Cyrillic text may well hold such letters, so they prove nothing there.
_SIGNS = re.compile(f"(?<![{_CYR}])Ш(?=[0-9])|(?<=[0-9\"”″'’]) Ч (?=[0-9])")
_LONE = re.compile(f"(?<![{_CYR}])[{_CYR}]{{1,3}}(?![{_CYR}])")


#: Share of each letter in Russian text, in ten-thousandths.
LETTER_SHARE = dict(zip("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", [1097, 845, 801, 735, 670, 626, 547, 473, 454, 440, 349, 321, 298, 281, 262, 201, 190, 174, 170, 165, 159, 144, 121, 97, 94, 73, 64, 48, 36, 32, 26, 4, 4]))
CYRILLIC = ["cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic"]


def weight(text: str) -> tuple[float, int]:
    """Log-likelihood as Russian, in nats, and number of weighed characters; digits and marks that stand beside words anyway are not weighed."""
    letters = [c for c in text.lower() if not (c.isascii() or c in "№§" or (c in CLOSING and c != "\u00a0"))]
    return sum(math.log(LETTER_SHARE.get(c, 1) / 10_000) for c in letters), len(letters)


def gain(new: str, old: str) -> float:
    """How much likelier, in nats, one reading is as Russian than the other."""
    return weight(new)[0] - weight(old)[0]


_TOKEN = re.compile(r"[^\x00-\x40\x5b-\x60\x7b-\x7f]{3,}")
LEAST_GAIN = 10.0


@cache
def _unlikely(token: str) -> bool:
    w, n = weight(token)
    return n >= 3 and (w / n < -3.9 or not all(c.isalpha() or c.isascii() or c in CLOSING or c in "№§" for c in token.strip("\u00a0")) or "\u00a0" in token.strip("\u00a0"))


def _between_cyrillic(text: str) -> tuple[str, list[str]]:
    """Cyrillic text read with another Cyrillic encoding: the pair that makes unlikely words likely ones, two at least."""
    if not re.search("[\u0400-\u04ff]", text):
        return text, []
    odd = [t for t in _TOKEN.findall(text) if _unlikely(t)]
    if len(odd) < 2:
        return text, []
    best = (LEAST_GAIN, "", "")
    for right in CYRILLIC:
        for wrong in CYRILLIC:
            if right == wrong:
                continue
            total, words = 0.0, 0
            for t in odd:
                new = _recode(t, wrong, right)
                if new is not None and _like_a_word(new) and gain(new, t) >= 2 and not _unlikely(new):
                    total, words = total + gain(new, t), words + 1
            if words >= 2 and total > best[0]:
                best = (total, right, wrong)
    _, right, wrong = best
    if not right:
        return text, []

    def one(m: re.Match) -> str:
        new = _recode(m.group(), wrong, right)
        return new if new is not None and gain(new, m.group()) > 0 else m.group()

    return re.sub(r"[^\x00-\x7f]+", one, text), [f"{right} read as {wrong}"]


def _like_a_word(text: str) -> bool:
    return text[1:] == text[1:].lower() or text == text.upper()


def _one_for_one(text: str) -> tuple[str, list[str]]:
    """Pairs of encodings of which neither is UTF-8, by the shape of the words they leave."""
    used: list[str] = []

    def apply(pattern: re.Pattern, wrong: str, right: str, fault: str, sound) -> None:
        nonlocal text

        def one(m: re.Match) -> str:
            new = _recode(m.group(), wrong, right)
            return new if new is not None and sound(new) else m.group()

        new_text = pattern.sub(one, text)
        if new_text != text or fault not in used:
            used.append(fault)
        text = new_text

    japanese = re.compile("[\u3040-\u30ff\u4e00-\u9fff]").search
    pairs = sum(len(m.group()) // 2 for m in _SJIS.finditer(text))
    if pairs and len(_UTF8_AS_WESTERN.findall(text)) < pairs:
        apply(_SJIS_SPAN, "cp1252", "cp932", "shift_jis read as cp1252", japanese)
    if _EUC.search(text):
        apply(_EUC_SPAN, "cp1252", "euc_jp", "euc_jp read as cp1252", japanese)
    runs = [r for r in map(lambda m: _recode(m.group(), "cp1252", "cp1251") or "", _WESTERN_RUN.finditer(text)) if _CYR_WORD.fullmatch(r) and _like_a_word(r)]
    runs = [r for r in runs if r != r.upper() or len(r) >= 5]
    # garbled UTF-8 can leave such runs as well; it then explains more of the text than they do
    if (any(len(r) >= 4 for r in runs) or len(runs) >= 2) and sum(end - start for start, end, *_ in _span_repair().spans(text)) < sum(map(len, runs)):
        apply(_WESTERN_WORD, "cp1252", "cp1251", "cp1251 read as cp1252", lambda w: bool(_CYR_WORD.fullmatch(w)) and _like_a_word(w))
    return text, used


def _turned_case(text: str) -> tuple[str, list[str]]:
    """KOI8 read as Windows Cyrillic turns the case over: lower-case words come out in capitals."""
    used: list[str] = []
    odd = [w for w in _KOI.findall(text) if len(w) >= 4 and sum(c.isupper() for c in w) >= len(w) / 2]
    # the case is turned over in such text; letters must be likelier, too, as names may be written so
    read = [_recode(w, "cp1251", "koi8_r") or w for w in odd]
    if odd and sum(map(gain, read, odd)) > 0 and 2 * sum(map(_unlikely, read)) < len(odd):

        def koi8(m: re.Match) -> str:
            new = _recode(m.group(), "cp1251", "koi8_r")
            garbled = m.group().isupper() if len(m.group()) == 1 else not (m.group()[1:].islower())
            return new if new and garbled and new[1:] == new[1:].lower() else m.group()

        new_text = _CYR_WORD.sub(koi8, text)
        if new_text != text:
            used.append("koi8_r read as cp1251")
            text = new_text
    return text, used


def _after_spans(text: str) -> tuple[str, list[str]]:
    """What is left when no garbled UTF-8 remains: central European, mixed scripts, control characters."""
    used: list[str] = []
    if _POLISH_SURE.search(text):
        words = "".join(_POLISH_WORD.findall(text))
        right = "iso8859_2" if sum(words.count(c) for c in "±¶¼") > sum(words.count(c) for c in "¹œŸ\x9c\x9f") else "cp1250"
        text = _POLISH_WORD.sub(lambda m: _recode(m.group(), "cp1252", right) or m.group(), text)
        used.append(f"{right} read as cp1252")
    if _MIXED.search(text):
        text = _MIXED.sub(lambda m: _recode(m.group(), "cp1251", "cp1252") or m.group(), text)
        if not re.search(f"[{_CYR}]{{4,}}", text):
            text = _LONE.sub(lambda m: _recode(m.group(), "cp1251", "cp1252") or m.group(), text)
        used.append("cp1252 read as cp1251")
    if _SIGNS.search(text) and not re.search(f"[{_CYR}]{{3,}}", text) and re.search("[A-Za-z]{3}", text):
        text = _SIGNS.sub(lambda m: _recode(m.group(), "cp1251", "cp1252") or m.group(), text)
        used.append("cp1252 read as cp1251")
    if _C1.search(text):
        text = _C1.sub(lambda m: "".join(byte_table("cp1252")[ord(c)] for c in m.group()), text)
        used.append("cp1252 read as latin_1")
    return text, used


def restore(text: str | None) -> tuple[bool, str | None, list[str]]:
    """(affected, text with all recognised spans restored, encodings at fault)."""
    if not text or text.isascii():
        return False, text, []
    text, faults = _one_for_one(text)
    # each pass shortens the text, so this ends however often it was garbled
    while True:
        text, used = _span_repair().once(text)
        if not used:
            break
        faults += [f"utf_8 read as {e}" for e in dict.fromkeys(used)]
    for step in (_turned_case, _between_cyrillic, _after_spans):
        text, used = step(text)
        faults += used
    if "\ufffd" in text:
        faults.append("lost characters")
    return bool(faults), text, list(dict.fromkeys(faults))


def repair(docs: DataFrame) -> DataFrame:
    """``(doc_id, restored, complete, faults)`` of every affected document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                hit, restored, faults = restore(text)
                if hit:
                    rows.append((doc_id, restored, "lost characters" not in faults, faults))
            yield pd.DataFrame(rows, columns=["doc_id", "restored", "complete", "faults"])

    kept = docs.filter(F.col("text").rlike(r"[^\x00-\x7F]")).select("doc_id", "text")
    return kept.mapInPandas(run, "doc_id bigint, restored string, complete boolean, faults array<string>")
