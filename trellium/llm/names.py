"""Folding and edit distance shared by the name operators."""

from __future__ import annotations

import html
import re
import unicodedata

_LETTERS = str.maketrans({"ß": "s", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l", "ı": "i"})
_MARKS = re.compile(r"[\u0300-\u036f]+")


def skeleton(text: str, digraphs: bool = True) -> str:
    """Lower-case letters without accents; with ``digraphs``, ae, oe and ue count as ä, ö and ü do."""
    text = text.lower()
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    if digraphs:
        text = text.replace("ae", "a").replace("oe", "o").replace("ue", "u")
    if text.isascii():
        return text
    text = _MARKS.sub("", unicodedata.normalize("NFKD", text)).translate(_LETTERS)
    return text if text.isascii() else "".join(c for c in text if not unicodedata.combining(c))


def words(text: str, digraphs: bool = True) -> list[str]:
    """Runs of letters or digits of the skeleton."""
    return re.findall(r"[^\W\d_]+|\d+", skeleton(text, digraphs))


def osa_within(a: str, b: str, k: int) -> int | None:
    """Banded edit distance with swaps of neighbours as one edit; None above ``k``."""
    if abs(len(a) - len(b)) > k:
        return None
    if a == b:
        return 0
    big = k + 1
    before: list[int] = []
    last = [j if j <= k else big for j in range(len(b) + 1)]
    for i in range(1, len(a) + 1):
        row = [big] * (len(b) + 1)
        if i <= k:
            row[0] = i
        for j in range(max(1, i - k), min(len(b), i + k) + 1):
            d = last[j - 1] + (a[i - 1] != b[j - 1])
            d = min(d, last[j] + 1, row[j - 1] + 1)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, before[j - 2] + 1)
            row[j] = d
        before, last = last, row
        if min(row) > k:
            return None
    return last[len(b)] if last[len(b)] <= k else None


def one_deletions(word: str) -> set[str]:
    """The word and all forms with one letter deleted: two words within one edit share such a form."""
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}
