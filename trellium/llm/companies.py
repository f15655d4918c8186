"""Reading typed employer names: core, trade, legal form.

Legal forms are a closed list; what is a trade and what has no weight is learned
from the names (``llm.roles``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellium.llm.names import words
from trellium.llm.roles import MIN_CORES, Lexicon, learn_lexicon
from trellium.session import cut

# Legal forms of companies.
LEGAL_FORMS = {
    "gmbh": ["gmbh", "gesellschaft mit beschrankter haftung", "gesellschaft mbh", "g m b h", "mbh"],
    "cokg": ["gmbh co kg", "gmbh und co kg", "gmbh and co kg", "gmbh u co kg", "gmbh cokg", "co kg"],
    "ag": ["ag", "a g", "aktiengesellschaft"],
    "kg": ["kg", "k g", "kommanditgesellschaft"],
    "se": ["se", "s e", "societas europaa", "societas europaea"],
    "ek": ["ek", "e k", "eingetragener kaufmann", "eingetragene kauffrau"],
    "ltd": ["ltd", "limited", "l t d"],
    "sarl": ["sarl", "s a r l", "societe a responsabilite limitee"],
    "ohg": ["ohg", "o h g", "offene handelsgesellschaft"],
    "ug": ["ug", "u g", "unternehmergesellschaft", "ug haftungsbeschrankt"],
    "sa": ["sa", "s a"], "sas": ["sas", "s a s"], "srl": ["srl", "s r l"], "inc": ["inc"], "llc": ["llc"], "plc": ["plc"], "bv": ["bv", "b v"], "nv": ["nv", "n v"],
    "sro": ["sro", "s r o"], "spzoo": ["sp z o o", "spzoo"], "lda": ["lda"], "sl": ["sl", "s l"], "gbr": ["gbr"], "ev": ["e v"], "eg": ["e g"],
}


#: A shortened trade that fits several: it says nothing.
ANY_TRADE = "*"


def _legal_index() -> dict[tuple[str, ...], str]:
    return {tuple(form.split()): kind for kind, forms in LEGAL_FORMS.items() for form in forms}


_LEGAL = _legal_index()
_LEGAL_LONGEST = max(len(k) for k in _LEGAL)


def _folded(word: str) -> str:
    return word.replace("ae", "a").replace("oe", "o").replace("ue", "u")


def _legal_form(toks: list[str]) -> tuple[str, list[bool]]:
    """The first legal form named, and which words belong to one; a name does not begin with its form."""
    used, legal = [False] * len(toks), ""
    for size in range(min(_LEGAL_LONGEST, len(toks)), 0, -1):
        for i in range(len(toks) - size + 1):
            key = tuple(toks[i : i + size])
            if key in _LEGAL and not any(used[i : i + size]) and (i > 0 or size == len(toks)):
                legal = legal or _LEGAL[key]
                used[i : i + size] = [True] * size
    return legal, used


def telling_words(name: str | None) -> list[str]:
    """Folded words of a name without its legal form."""
    toks = [_folded(w) for w in words(name, digraphs=False)] if name else []
    return [t for t, u in zip(toks, _legal_form(toks)[1]) if not u]


def learn_companies(names: DataFrame, col: str) -> Lexicon:
    """The lexicon of all distinct values of a column of employer names."""

    @F.pandas_udf("array<string>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(telling_words)

    # written first: a filter on the words would else be pushed below, and split every row
    distinct = cut(names.select(F.col(col).alias("name")).filter("name is not null").distinct(), "company-names")
    lexicon = learn_lexicon(distinct.select(split("name").alias("words")), "words")
    if not lexicon.trades:
        return lexicon

    @F.pandas_udf("array<string>")
    def digraphs(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda v: [w for w in words(v, digraphs=False) if _folded(w) != w and _folded(w) in lexicon.trades])

    # spellings of the trades with their digraphs: an edit may make or break one
    spelled = distinct.select(F.explode(digraphs("name")).alias("w")).groupBy("w").count().filter(F.col("count") >= MIN_CORES).collect()
    return Lexicon(lexicon.trades | {r.w: lexicon.trades[_folded(r.w)] for r in spelled}, lexicon.light)


def _trade_of(word: str, plain: str, short: bool, lexicon: Lexicon) -> str | None:
    """The trade that a word names, with or without its digraphs: within one edit, or cut off with a dot."""
    if short and len(word) >= 3:
        hits = {lexicon.trades[f] for f in lexicon.beginnings.get(word, ())}
        if hits:
            return hits.pop() if len(hits) == 1 else ANY_TRADE
    near = lexicon.close(word) | (lexicon.close(plain) if plain != word else set()) if len(word) >= 4 else set()
    return near.pop() if len(near) == 1 else None


def read_company(name: str | None, lexicon: Lexicon = Lexicon()) -> tuple[str, str, str, str, str]:
    """(core, core as typed, trade, legal form, words of the core) of a typed name; all '' when it names no employer.

    The core is what remains when trade, legal form and words of no weight are
    taken off, its words in binary order; as typed they keep their own order and
    their digraphs, since an edit may change either. Words with a dot behind them
    have it among the words. A name of nothing but shared words keeps its trade
    as the core.
    """
    if name is None or not re.search(r"\w", name):
        return "", "", "", "", ""
    plain = words(name, digraphs=False)
    toks = [_folded(w) for w in plain]
    dotted = {_folded(w) for part in re.findall(r"[\w\-]+(?=\.)", name) for w in words(part, digraphs=False)}
    legal, used = _legal_form(toks)
    trade = ""
    free = lambda: [i for i, u in enumerate(used) if not u]
    for i, j in zip(free(), free()[1:]):
        if not trade and j == i + 1 and toks[i] not in lexicon.trades and len(toks[i]) >= 2 and len(toks[j]) >= 3 and len(both := lexicon.of_two(toks[i], toks[j])) == 1:
            trade, used[i], used[j] = both.pop(), True, True
    if not trade:
        for i in free():
            if not trade and toks[i] in lexicon.trades:
                trade, used[i] = lexicon.trades[toks[i]], True
    for i in free():
        used[i] = lexicon.is_light(toks[i])
    if not trade:
        for i in free():
            if not trade and (found := _trade_of(toks[i], plain[i], toks[i] in dotted, lexicon)):
                trade, used[i] = found, True
    typed, parts = "".join(plain[i] for i in free()), sorted(toks[i] for i in free())
    if not parts:
        parts, trade = [trade or "".join(toks)], ""
    return "".join(parts), typed or parts[0], "" if trade == ANY_TRADE else trade, legal, " ".join(t + "." * (t in dotted) for t in parts)
