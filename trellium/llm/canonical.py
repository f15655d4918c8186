"""Mapping free-typed values to the entries of a reference list.

A multi-pattern automaton over the canonical names and their second names finds
mentions inside a value; the longest match wins and matches do not overlap.
What has no mention goes to token-set similarity: a name is similar when each of
its words is among the value's, in any order, or when neighbouring words of the
value, joined, are the name, where one edit in all is allowed. Words and names
within an edit are looked up by their forms with one letter left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from trellium.llm.names import one_deletions, osa_within, skeleton, words

# Small words inside place names, and words around them that name no place.
LINK_WORDS = ["am", "an", "auf", "bei", "der", "dem", "den", "des", "die", "im", "in", "ob", "unter", "vor", "zu", "zur", "zum", "a", "b", "d", "i", "o", "u", "v", "sur", "sous", "les", "le", "la", "de", "del", "upon", "on", "the", "near", "nad", "pod"]
MAX_ENTRIES = 100_000
_SAINT = {"st": "sankt", "skt": "sankt", "saint": "sankt"}


@dataclass
class Gazetteer:
    """``entries``: (id, name, second name or None). Names are split into a base and an
    optional qualifier ("am See", "(Land)"), since people drop or shorten the latter."""

    entries: list[tuple[int, str, str | None]]
    max_edits: int = 1
    min_fuzzy: int = 6
    by_base: dict[str, dict[str, int]] = field(default_factory=dict)
    exact: set[str] = field(default_factory=set)
    word_sets: dict[str, set[tuple[str, ...]]] = field(default_factory=dict)  # base to its words, as each name has them

    def __post_init__(self):
        import ahocorasick

        if len(self.entries) > MAX_ENTRIES:
            raise ValueError(f"the reference list may have at most {MAX_ENTRIES} entries")
        self.exact = {name for _, name, _ in self.entries}
        for place_id, name, other in self.entries:
            base, qualifier = self.split(name)
            # of two entries with one name the smaller id holds it
            for b in [base, *([self.split(other)[0]] if other else [])]:
                if not "".join(b):
                    continue  # a name without a letter or digit cannot be mentioned
                self.word_sets.setdefault("".join(b), set()).add(b)
                slot = self.by_base.setdefault("".join(b), {})
                slot[qualifier] = min(place_id, slot.get(qualifier, place_id))
        self.qualifiers = {q for slot in self.by_base.values() for q in slot if q}
        self.auto = ahocorasick.Automaton()
        for b in self.by_base:
            self.auto.add_word(b, b)
        if self.by_base:
            self.auto.make_automaton()
        self.near: dict[str, list[str]] = {}
        for b in self.by_base:
            if len(b) >= self.min_fuzzy:
                for form in one_deletions(b):
                    self.near.setdefault(form, []).append(b)
        self.longest_name = max(map(len, self.by_base), default=0)
        self.longest = max((len(w) for sets in self.word_sets.values() for w in sets), default=1)
        self.near_word: dict[str, list[tuple[str, tuple[str, ...], int]]] = {}
        for b, sets in self.word_sets.items():
            for w in sets:
                for i, word in enumerate(w if len(w) > 1 else ()):
                    for form in one_deletions(word) if len(word) >= self.min_fuzzy - 1 else {word}:
                        self.near_word.setdefault(form, []).append((b, w, i))
        self.near_qualifier: dict[str, list[str]] = {}
        for q in sorted(self.qualifiers):
            for form in one_deletions(q) if len(q) >= 4 else ():
                self.near_qualifier.setdefault(form, []).append(q)

    @staticmethod
    def split(name: str) -> tuple[tuple[str, ...], str]:
        """Words of the base, and the qualifier, as skeleton letters."""
        head, tail = name, ""
        if m := re.match(r"^([^(/]+?)\s*(?:\(|/)\s*(.+?)\)?\s*$", name):
            head, tail = m.groups()
        else:
            w = name.split()
            at = next((i for i, x in enumerate(w) if i and x.casefold().strip(".") in LINK_WORDS), None)
            if at:
                head, tail = " ".join(w[:at]), " ".join(w[at:])
        content = [x for x in words(tail) if x not in LINK_WORDS]
        return tuple(words(head)), (content[-1] if content else "")

    def _mentions(self, toks: list[str]) -> list[tuple[int, int, str]]:
        """Longest non-overlapping matches at word limits: (first token, end token, base)."""
        joined = "".join(toks)
        starts, at = {}, 0
        for i, t in enumerate(toks):
            starts[at] = i
            at += len(t)
        ends = {p: i for p, i in starts.items()} | {at: len(toks)}
        found = []
        for end, base in self.auto.iter(joined) if self.by_base else ():
            a, b = end - len(base) + 1, end + 1
            if a in starts and b in ends:
                found.append((starts[a], ends[b], base))
        found.sort(key=lambda m: (-len(m[2]), m[0]))
        taken, out = set(), []
        for a, b, base in found:
            if not taken & set(range(a, b)):
                taken |= set(range(a, b))
                out.append((a, b, base))
        return sorted(out)

    def _joined(self, toks: list[str]) -> Iterator[tuple[int, int, int, int, str]]:
        """(edits, -length, first token, end token, base) of neighbouring words that are a name together."""
        for a in range(len(toks)):
            w = ""
            for b in range(a + 1, len(toks) + 1):
                w += toks[b - 1]
                # every further word has a letter at least
                if b - a > self.longest + 1 and len(w) > self.longest_name + self.max_edits:
                    break
                if len(w) < self.min_fuzzy - 1 or w.isdigit():
                    continue
                for form in one_deletions(w):
                    for base in self.near.get(form, ()):
                        d = osa_within(w, base, self.max_edits)
                        if d is not None:
                            yield d, -len(base), a, b, base

    def _word_sets(self, toks: list[str], edits: int) -> Iterator[tuple[int, int, int, int, str]]:
        """The same of names of several words, each of which is among the value's, wherever it stands."""
        met: dict[tuple[str, tuple[str, ...]], list[dict[int, int]]] = {}
        for at, t in enumerate(toks if self.near_word else ()):
            for form in one_deletions(t) if edits and len(t) >= self.min_fuzzy - 1 else {t}:
                for base, name, i in self.near_word.get(form, ()):
                    d = osa_within(t, name[i], edits)
                    if d is not None:
                        places = met.setdefault((base, name), [{} for _ in name])[i]
                        places[at] = min(d, places.get(at, d))
        for (base, name), places in met.items():
            taken: list[tuple[int, int]] = []  # (token, edits), the word with the fewest places first
            for options in sorted(places, key=len):
                free = [(d, at) for at, d in options.items() if at not in {x for x, _ in taken}]
                if not free:
                    break
                d, at = min(free)
                taken.append((at, d))
            if len(taken) == len(name) and sum(d for _, d in taken) <= edits:
                yield sum(d for _, d in taken), -len(base), min(x for x, _ in taken), max(x for x, _ in taken) + 1, base

    def _similar(self, toks: list[str]) -> list[tuple[int, int, str]]:
        """The similar name with the fewest edits, of those the longest; none where two are equally near."""
        best = [*self._joined(toks), *self._word_sets(toks, self.max_edits)]
        if not best:
            return []
        d, _, a, b, base = min(best)
        if len({x[4] for x in best if x[0] == d and -x[1] == len(base)}) > 1:
            return []
        return [(a, b, base)]

    def _reordered(self, toks: list[str], hits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """A name whose words all occur, in another order, and which holds every mention: it is what was meant."""
        whole = sorted(x for x in self._word_sets(toks, 0) if all(-x[1] > len(h[2]) and x[2] <= h[0] and h[1] <= x[3] for h in hits))
        names = {x[4] for x in whole if x[1] == whole[0][1]}
        return [(whole[0][2], whole[0][3], whole[0][4])] if len(names) == 1 else hits

    def _qualifier(self, toks: list[str]) -> str | None:
        """The known qualifier among the words behind a mention, '' without any; None for a qualifier nobody has."""
        for t in toks:
            t = _SAINT.get(t, t)
            if t in self.qualifiers:
                return t
            near = {q for form in one_deletions(t) for q in self.near_qualifier.get(form, ()) if osa_within(t, q, 1) is not None} if len(t) >= 4 else ()
            if near:
                return min(near)
        return ""

    def resolve(self, value: str | None) -> int:
        """The id of the place meant, 0 if none."""
        if value is None or not value.strip():
            return 0
        toks = words(value)
        hits = self._reordered(toks, found) if (found := self._mentions(toks)) else self._similar(toks)
        if not hits:  # an edit may have made or broken a digraph
            toks = words(value, digraphs=False)
            hits = self._similar(toks)
        for i, (_, b, base) in enumerate(hits):
            stop = hits[i + 1][0] if i + 1 < len(hits) else len(toks)
            slot = self.by_base[base]
            q = self._qualifier(toks[b:stop])
            if q in slot:
                return slot[q]
            if q == "" and len(slot) == 1:
                return next(iter(slot.values()))
        return 0


_CACHE: dict = {}


def gazetteer_of(entries: tuple) -> Gazetteer:
    if entries not in _CACHE:
        _CACHE.clear()
        _CACHE[entries] = Gazetteer(list(entries))
    return _CACHE[entries]


def canonical_id(value: Column, entries: list[tuple[int, str, str | None]]) -> Column:
    """Id (bigint) of the entry that a typed value means; 0 if none, also for NULL and blanks.

    ``entries`` come from a reference list of at most 100,000 rows. Values keep
    their rows, so no value is gathered in one task however often it occurs;
    equal values of a batch are resolved once. Where two names are equally near
    the value is left unmatched.
    """
    fixed = tuple(entries)

    @F.pandas_udf("bigint")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        g = gazetteer_of(fixed)
        seen: dict[str, int] = {}
        for s in batches:
            codes, values = pd.factorize(s, use_na_sentinel=True)
            ids = []
            for v in values:
                if v not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen[v] = g.resolve(v)
                ids.append(seen[v])
            ids.append(0)
            yield pd.Series([ids[c] for c in codes], dtype="int64")

    return run(value)


def load_entries(gazetteer, id_col: str = "place_id", name: str = "place", other: str = "alt_name") -> list[tuple[int, str, str | None]]:
    """Rows of the reference list, refused beyond its bound; rows without a name are left out."""
    rows = gazetteer.filter(F.col(name).isNotNull()).select(id_col, name, other).limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"the reference list may have at most {MAX_ENTRIES} entries")
    return sorted((int(r[0]), r[1], r[2] or None) for r in rows)
