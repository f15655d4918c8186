"""Finding and restoring text that was decoded in a wrong character encoding.

Each suspicious word is the start of a best-first search whose edges are
"encode as A, decode as B" and "unescape"; states seen before are not entered
again, and a cost of character plausibility, given neighbours and the
document's languages, says which state to look at next. The cheapest state
reached within the budget is the restored word.
"""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters beyond ASCII of the languages, and frequent small words.
ALPHABETS = {
    "de": "äöüßÄÖÜ", "en": "éï", "fr": "àâæçéèêëîïôœùûüÿÀÂÇÉÈÊËÎÏÔŒÙÛÜ", "es": "áéíóúüñÁÉÍÓÚÜÑ", "pt": "áâãàçéêíóôõúÁÂÃÀÇÉÊÍÓÔÕÚ",
    "pl": "ąćęłńóśźżĄĆĘŁŃÓŚŹŻ", "cs": "áčďéěíňóřšťúůýžÁČĎÉĚÍŇÓŘŠŤÚŮÝŽ",
}
SMALL_WORDS = {
    "de": "und der die das für mit ist sind von im den ein eine wir sie bei nicht oder auf zum zur", "en": "the and of to with for is are our you we at on by this that or from", "fr": "le la les et des pour une dans est vous nous sur avec au du de un",
    "es": "el los las para con una del por un que es se su al y en de la", "pt": "os as uma com para do da em no na um que de se por dos", "pl": "w na z oraz do od dla jest się razem z działem osoby o i", "cs": "v na se pro od do je za jsou nebo a o k místě týmu",
}
#: Encodings that a reader may wrongly assume, and those that a text may really have.
ASSUMED = ["cp1252", "latin-1", "cp1250", "iso8859-2", "mac_roman", "cp437", "cp850", "cp852", "cp1251", "iso8859-15"]
ACTUAL = ["utf-8", "cp1252", "cp1250", "iso8859-2", "mac_roman", "cp437", "cp850", "cp852"]
#: Conversions from one one-byte encoding to another: the most in a row, and the most states of a word reached by one that are
#: gone on from. Steps that join bytes to characters or unescape shorten the text and are followed however many there are.
MAX_STATES, MAX_DEPTH = 48, 3
_SHORTENING = ("utf-8", "unescape")
FOREIGN = 2.5
DETOUR = 3.0  # a state may cost so much more than the start and still lead on
#: Cost that a repair must save in one word, for a change of letters and for bytes that join to UTF-8 characters; and in a whole text.
WORD_GAIN, JOINED_GAIN, DOCUMENT_GAIN, BROKEN_GAIN = 3.0, 1.0, 6.0, 2.0
_BROKEN = re.compile(r"[a-zß-öø-ÿ](?:[À-ÖØ-Þ]|[\u02b0-\u02ff\u2200-\u22ff\u2500-\u25ff\u0370-\u03ff]|ﬂ)|[bcdfghjklmnpqrstvwxz]ß|[a-ln-zß-öø-ÿ][¹²³]")

_SETS = {k: set(v) for k, v in ALPHABETS.items()}
_ANY_LETTER = set("".join(ALPHABETS.values()))
_SMALL = {k: frozenset(v.split()) for k, v in SMALL_WORDS.items()}
_LONE = {"fr": "àÀôÔ", "es": "áóéÓÁ", "pt": "àéóáÀÉÓÁ", "pl": "óÓ", "cs": "áíóú"}
#: Signs that may stand inside a word, with their cost there.
_INNER = {"’": 0.0, "'": 0.0, "‑": 0.0, "‐": 0.0, "\xad": 0.0, "\u200b": 0.0, "\u200c": 0.0, "\u200d": 0.0, "\xa0": 1.0, "\u202f": 1.0, "–": 1.5, "—": 1.5, "·": 2.5, "‘": 2.5}
_PUNCTUATION = set("–—‑‒‐―’‘‚“”„‟«»‹›•·…‧€£¥¢§¶°±µ²³¹¼½¾×÷©®™¿¡ºª†‡‰′″−→←↑↓✓★☆■□▪●○◆►      ​‌‍­﻿  ")
_SPACING_MARKS = set("¸´¨ˆ˜˙˘ˇ˝˛¯ˉ")
_OPEN_CLOSE = set("’‘‚“”„«»‹›…")


def _tables():
    decode = {}
    for e in {*ASSUMED, *ACTUAL} - {"utf-8"}:
        decode[e] = {}
        for b in range(128, 256):
            try:
                decode[e][b] = bytes([b]).decode(e)
            except UnicodeDecodeError:
                decode[e][b] = chr(b)  # unassigned bytes come out as control characters
    return decode, {e: {c: b for b, c in t.items()} for e, t in decode.items()}


_DECODE, _ENCODE = _tables()


def char_cost(c: str, before: str, after: str, languages: frozenset[str]) -> float:
    """How implausible one character beyond ASCII is between its neighbours."""
    if c == "�":
        return 10.0
    if "\x80" <= c <= "\x9f":
        return 8.0
    if c in _PUNCTUATION:
        left, right = before.isalpha(), after.isalpha()
        if c in "¿¡":
            return 4.5 if left or not after.isalpha() else 0.0
        if left and right:
            return _INNER.get(c, 5.0)
        if c in "²³":
            return 0.0 if before in "mM" or not (left or right) and before.isdigit() else 4.0
        if c in "°":
            return 0.0 if not left else 3.0
        if c in "¹¼½¾ºª¶†‡‰¢¥×÷":
            return 3.0 if left or right else 0.5
        if c in "±µ":
            return 3.0 if left else 0.0
        if c in "•·§€£" and left:
            return 2.0
        return 0.0
    if c in _SPACING_MARKS:
        return 5.0
    if unicodedata.combining(c):
        return 3.0 if before.isalpha() or (before and unicodedata.combining(before)) else 4.0  # one that joins no letter
    if c in _ANY_LETTER:
        cost = 0.0
    elif c.isalpha() and unicodedata.name(c, "").startswith("LATIN"):
        cost = 4.0
    else:  # signs and other scripts: odd beside letters, plausible alone
        return 6.0 if before.isalpha() or after.isalpha() else 2.0
    if before.islower() and c.isupper():
        cost += 4.0
    if c == "ß":
        cost += 0.0 if before and before.lower() in "aeiouäöüy" else 4.5
    if not before.isalnum() and not after.isalnum() and not (after and unicodedata.combining(after)):
        cost += 0.0 if any(c in _LONE.get(k, "") for k in languages) else 4.0
    return cost


def foreign_cost(text: str, languages: frozenset[str]) -> float:
    """Cost of letters that the document's languages lack: for each, or once where one other language has them all."""
    odd = {c for c in text if c in _ANY_LETTER}
    foreign = sum(1 for c in text if c in _ANY_LETTER and not any(c in _SETS[k] for k in languages))
    if not foreign:
        return 0.0
    return FOREIGN if any(odd <= s for s in _SETS.values()) else FOREIGN * foreign


@lru_cache(maxsize=200_000)
def text_cost(text: str, languages: frozenset[str]) -> float:
    total = 0.0
    for i, c in enumerate(text):
        if c > "\x7f":
            total += char_cost(c, text[i - 1 : i], text[i + 1 : i + 2], languages)
    return total + foreign_cost(text, languages)


def languages_of(text: str, odd_words: set[str]) -> frozenset[str]:
    """Languages whose small words the text has in number, or has at all when their
    letters explain its words beyond ASCII; German and English names occur in all of them."""
    hits = {k: 0 for k in _SMALL}
    for w in text.lower().split():
        for k, small in _SMALL.items():
            if w in small:
                hits[k] += 1
    top = max(hits.values())
    out = {"de", "en"} | {k for k, n in hits.items() if n >= 3 and n >= 0.35 * top}
    base = frozenset(out)
    odd = [w for w in odd_words if text_cost(w, base) > 0]
    for k, n in hits.items():
        if odd and n and k not in out and sum(text_cost(w, base | {k}) == 0 for w in odd) >= 0.9 * len(odd):
            out.add(k)
    return frozenset(out)


def _convert(text: str, assumed: str, actual: str) -> str | None:
    """Encode as ``assumed``, decode as ``actual``; None where that is impossible or changes nothing."""
    table = _ENCODE[assumed]
    raw = bytearray()
    for c in text:
        if c <= "\x7f":
            raw.append(ord(c))
        else:
            b = table.get(c)
            if b is None:
                return None
            raw.append(b)
    if actual == "utf-8":
        try:
            return bytes(raw).decode("utf-8")
        except UnicodeDecodeError:
            return None
    if assumed == actual:
        return None
    to = _DECODE[actual]
    return "".join(chr(b) if b < 128 else to[b] for b in raw)


def neighbours(text: str) -> Iterator[tuple[str, str]]:
    """(operation, text) for every edge out of a state."""
    seen = set()
    for a in ASSUMED:
        for b in ACTUAL:
            t = _convert(text, a, b)
            if t is not None and t != text and t not in seen:
                seen.add(t)
                yield f"{a}>{b}", t
    if "&" in text and (t := html.unescape(text)) != text and t not in seen:
        yield "unescape", t


@lru_cache(maxsize=200_000)
def restore_word(word: str, languages: frozenset[str]) -> tuple[str, float, str]:
    """(cheapest reachable word, cost saved, operations); the word itself and 0 when nothing is better."""
    start = text_cost(word, languages)
    if start == 0.0 or "�" in word:
        return word, 0.0, ""
    best, best_cost, best_ops = word, start, ""
    queue: list[tuple[float, int, int, str, str, float]] = [(start, 0, 0, word, "", 0.0)]
    visited = {word}
    sideways = pushed = 0
    while queue:
        cost, depth, _, state, ops, spent = heapq.heappop(queue)
        if cost < best_cost - 0.25:
            best, best_cost, best_ops = state, cost, ops
            if cost <= 0.5:
                break
        if ops and cost > start + DETOUR:
            continue
        if ops and not ops.endswith(_SHORTENING):
            sideways += 1
        further = depth < MAX_DEPTH and sideways < MAX_STATES
        for op, t in neighbours(state):
            if t in visited or not (further or op.endswith(_SHORTENING)):
                continue
            visited.add(t)
            pushed += 1
            # many bytes that make one character prove more than a change of letters
            step = spent + (0.25 if op.endswith("utf-8") else 2.0)
            if not op.endswith("utf-8") and sum(map(str.isalpha, t)) < sum(map(str.isalpha, state)):
                step += 0.25  # letters rather stay letters
            heapq.heappush(queue, (text_cost(t, languages) + step, depth + (not op.endswith(_SHORTENING)), pushed, t, f"{ops} {op}".strip(), step))
    return (best, start - best_cost, best_ops) if best != word else (word, 0.0, "")


_BREAK = re.compile(r"[ \t\r\n]+")
_WORD = re.compile(r"[^ \t\r\n]+")


def odd_words(text: str) -> set[str]:
    """Distinct words beyond ASCII, letters and their marks joined."""
    return {unicodedata.normalize("NFC", w) for w in set(_BREAK.split(text)) if not w.isascii()}


def _suspects(words: set[str], languages: frozenset[str]) -> dict[str, tuple[str, float, str]]:
    return {w: restore_word(w, languages) for w in words if text_cost(w, languages) >= 1.0}


def _convincing(word: str, found: tuple[str, float, str]) -> bool:
    if "utf-8" in found[2]:
        return found[1] >= JOINED_GAIN
    if not any(c.isascii() and c.isalpha() for c in word):
        return False
    # a sign, a capital or a sharp s where no spelling has one needs less proof than a foreign letter
    broken = found[1] >= BROKEN_GAIN and _BROKEN.search(word) is not None and sum(map(str.isalpha, found[0])) >= sum(map(str.isalpha, word))
    return broken or found[1] >= WORD_GAIN


def _apply(word: str, ops: str) -> str | None:
    for op in ops.split(" "):
        t = html.unescape(word) if op == "unescape" else _convert(word, *op.split(">"))
        if t is None:
            return None
        word = t
    return word


def _repair(text: str, words: set[str], languages: frozenset[str]) -> tuple[bool, str]:
    suspects = _suspects(words, languages)
    by_op: dict[str, float] = {}
    for _, gain, op in suspects.values():
        by_op[op] = by_op.get(op, 0.0) + gain
    change = {w: r[0] for w, r in suspects.items() if r[1] > 0 and (_convincing(w, r) or by_op[r[2]] >= DOCUMENT_GAIN)}
    if not change:
        return any("�" in w for w in suspects), text
    # what has happened to some words of a text has mostly happened to the others
    common = sorted({suspects[w][2] for w in change}, key=lambda op: (-by_op[op], op))[:3]
    for w in words:
        if w not in change or suspects[w][2] not in common[:1]:
            for ops in common:
                t = _apply(w, ops)
                if t is not None and text_cost(t, languages) < text_cost(change.get(w, w), languages):
                    change[w] = t
                    break
    return True, _WORD.sub(lambda m: m.group() if m.group().isascii() else change.get(unicodedata.normalize("NFC", m.group()), m.group()), text)


def examine(text: str | None) -> tuple[bool, str | None]:
    """Whether a text holds garbled passages, and the text with those restored that can be."""
    if text is None or text.isascii():
        return False, text
    words = odd_words(text)
    languages = languages_of(text, words)
    garbled, restored = _repair(text, words, languages)
    if garbled and restored != text:
        # a text garbled as a whole shows its languages only now
        seen = languages_of(restored, odd_words(restored)) | languages
        if seen != languages:
            restored = _repair(text, words, seen)[1]
    return garbled, restored


def examined(text: Column) -> Column:
    """struct(garbled boolean, restored string) of a text.

    NULL and ASCII-only texts are not garbled; replacement characters make a
    text garbled though nothing can be restored there. Texts of any length are
    read whole, in time linear in their length; equal words of a worker are
    searched once.
    """

    @F.pandas_udf("garbled boolean, restored string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([examine(v) for v in s], columns=["garbled", "restored"])

    return run(text)


def is_garbled(text: Column) -> Column:
    @F.pandas_udf("boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([examine(v)[0] for v in s], dtype=bool)

    return run(text)
