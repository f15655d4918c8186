"""Text expressions: folding, terms, clipping, compaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trellium.functions.urls import let, unquote

_UMLAUTS = [("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def folded(x: Column | str) -> Column:
    """Percent-decoded and in lower case, with ß as ss; NULL is ''."""
    return F.replace(F.lower(unquote(F.coalesce(_c(x), F.lit("")))), F.lit("ß"), F.lit("ss"))


def transliterated(x: Column | str) -> Column:
    """Folded, umlauts written with e."""
    out = folded(x)
    for a, b in _UMLAUTS[:3]:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def fold_term(term: str, umlauts: bool = False) -> str:
    t = term.strip().lower().replace("ß", "ss")
    for a, b in _UMLAUTS[:3] if umlauts else ():
        t = t.replace(a, b)
    return t


def unique_terms(terms: list[str]) -> list[str]:
    """Trimmed, blanks dropped, the first of equal terms in any case kept."""
    seen: dict[str, str] = {}
    for t in terms:
        t = t.strip()
        if t:
            seen.setdefault(fold_term(t), t)
    return list(seen.values())


def unique_items(items: Column) -> Column:
    """As ``unique_terms`` for an array column: inner white space collapsed, edge punctuation off, first spelling kept."""
    tidy = F.transform(items, lambda t: F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"^[\s\-–—:;,.•]+|[\s\-–—:;,.•]+$", ""))
    return let(tidy, lambda a: F.filter(a, lambda t, i: (t != "") & (F.array_position(F.transform(a, F.lower), F.lower(t)) == i + 1)))


def substring_hits(x: Column | str, terms: list[str]) -> Column:
    """Terms that occur anywhere in the folded text, in their order."""
    table = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(fold_term(t)).alias("key")) for t in unique_terms(terms)])
    return let(folded(x), lambda hay: F.transform(F.filter(table, lambda t: hay.contains(t["key"])), lambda t: t["term"]))


def _quoted(key: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+?^$|-/" else c for c in key)


def token_pattern(term: str) -> str:
    """A term in either spelling, not inside a longer word; for text folded in either way."""
    forms = sorted({_quoted(fold_term(term)), _quoted(fold_term(term, True))})
    return r"(^|[^\p{L}\p{N}_])(" + "|".join(forms) + r")($|[^\p{L}\p{N}_])"


def token_hits(x: Column | str, terms: list[str]) -> Column:
    """Terms that occur as words of their own, in their order."""
    found = [(t, token_pattern(t)) for t in unique_terms(terms)]
    both = F.concat(folded(x), F.lit("\n"), transliterated(x))
    return let(both, lambda hay: F.filter(F.array(*[F.when(hay.rlike(p), F.lit(t)) for t, p in found]), lambda t: t.isNotNull()))


def clip(x: Column | str, n: int, marker: str = "\n[truncated]") -> Column:
    """At most ``n`` characters, the last of them a marker where something was cut."""
    x = _c(x)
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, max(0, n - len(marker))), F.lit(marker))).otherwise(x)


def truncate(x: Column | str, n: int) -> Column:
    """At most ``n`` characters, an ellipsis for what was cut; nothing for n of 0 or less."""
    x = _c(x)
    return F.lit("") if n <= 0 else F.when(F.length(x) > n, F.concat(F.rtrim(F.substring(x, 1, n - 1)), F.lit("…"))).otherwise(x)


def token_estimate(x: Column | str) -> Column:
    return F.ceil(F.length(F.coalesce(_c(x), F.lit(""))) / 4.0)


def compacted(x: Column | str, terms: list[str], head: int = 180, relevant: int = 240, most: int = 14_000) -> Column:
    """Non-empty lines, the first ``head`` of them and then those with a relevant term."""
    lines = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"[ \t]+", " "), r"\r\n|\n|\r"), lambda s: F.trim(s)), lambda s: s != "")
    keys = "|".join(_quoted(t.lower()) for t in unique_terms(terms))

    def body(a: Column) -> Column:
        important = F.slice(F.filter(a, lambda s: F.lower(s).rlike(keys) if keys else F.lit(False)), 1, relevant)
        tail = F.when(F.size(important) > 0, F.concat(F.lit("\n\nLIKELY RELEVANT LINES:\n"), F.array_join(important, "\n"))).otherwise("")
        return F.substring(F.concat(F.array_join(F.slice(a, 1, head), "\n"), tail), 1, most)

    return let(lines, body)


def as_text(x: Column | str, n: int) -> Column:
    return F.substring(F.trim(F.coalesce(_c(x).cast("string"), F.lit(""))), 1, n)


def clamp_int(x: Column | str, lo: int, hi: int) -> Column:
    """A whole number within limits; the lower one where there is none."""
    return F.least(F.greatest(F.coalesce(_c(x).try_cast("int"), F.lit(lo)), F.lit(lo)), F.lit(hi))


#: Accented Latin letters and their base letters.
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿąćčďęěłńňřśšťůźżžőű"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaccdeelnnrsstuzzzou"


def company_words(x: Column | str) -> Column:
    """Employer name as plain words: accents off, & as and, other signs as spaces."""
    t = F.translate(F.lower(F.coalesce(_c(x), F.lit(""))), _ACCENTED, _PLAIN)
    t = F.replace(F.replace(t, F.lit("ß"), F.lit("ss")), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(t, r"[^a-z0-9]+", " "))


def mentions_company(x: Column, names: list[str]) -> Column:
    """The first of the names that a text mentions by its full or joined form; NULL if none."""
    words = company_words(x)
    plain = lambda n: " ".join("".join(c if c.isalnum() and c.isascii() else " " for c in _fold_name(n)).split())
    hits = [F.when(F.concat(F.lit(" "), words, F.lit(" ")).contains(f" {plain(n)} ") | F.replace(words, F.lit(" "), F.lit("")).contains(plain(n).replace(" ", "")), F.lit(n)) for n in names if plain(n)]
    return F.coalesce(*hits) if hits else F.lit(None).cast("string")


def _fold_name(name: str) -> str:
    return name.lower().translate(str.maketrans(_ACCENTED, _PLAIN)).replace("ß", "ss").replace("&", " and ")


def title_from_link(text: Column, path: Column) -> Column:
    """Link text, else the last path segment with its separators as spaces, in title case."""
    shown = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    tail = F.element_at(F.split(F.regexp_replace(unquote(path), "^/+|/+$", ""), "/"), -1)
    return F.substring(F.when(shown != "", shown).otherwise(F.initcap(F.trim(F.regexp_replace(tail, "[-_]+", " ")))), 1, 300)


def split_terms(x: Column | str) -> Column:
    """Parts of a list item: brackets off, split at spaced signs, leading conjunctions off, two letters at least."""
    flat = F.regexp_replace(_c(x), r"\([^)]*\)", " ")
    parts = F.transform(F.split(flat, r"\s+[/|]\s+|\s*[;,]\s+"), lambda t: F.trim(F.regexp_replace(F.trim(t), r"^(?i)(and|or|oder|und)\s+", "")))
    return F.filter(parts, lambda t: F.length(t) >= 2)


def term_regex(terms: list[str]) -> str:
    """One pattern for whole terms, white space in them matching spaces, underscores and hyphens."""
    keys = [r"[\s_-]+".join(_quoted(w) for w in t.split()) for t in unique_terms(terms)]
    return r"(?iU)(?:^|[^\p{L}\p{N}_])(?:" + "|".join(keys) + r")(?:$|[^\p{L}\p{N}_])"


def first_term(x: Column | str, terms: list[str]) -> Column:
    """The first of the terms, in their order, that a text holds; '' if none."""
    hits = substring_hits(x, terms)
    return F.coalesce(F.try_element_at(hits, F.lit(1)), F.lit(""))


def pattern_hits(x: Column | str, patterns: list[str]) -> Column:
    """The patterns that a text holds, in their order; letters of any script have two cases under (?i)."""
    t = F.coalesce(_c(x), F.lit(""))
    return F.filter(F.array(*[F.when(t.rlike(p.replace("(?i)", "(?iu)")), F.lit(p)) for p in patterns]), lambda p: p.isNotNull())


# Words of employer names that make no alias.
ALIAS_STOP_WORDS = ["gmbh", "ag", "se", "kg", "mbh", "co", "company", "corp", "corporation", "inc", "ltd", "limited", "llc", "plc", "group", "holding", "holdings", "deutschland", "germany", "international", "global", "the", "and", "und"]


def company_aliases(x: Column | str) -> Column:
    """Distinct short forms of an employer name, three letters at least: words, joined words, the first telling word, the first two apart and joined, initials."""
    words = company_words(x)

    def forms(telling: Column) -> Column:
        two = F.slice(telling, 1, 2)
        pair = F.when(F.size(telling) >= 2, F.array(F.array_join(two, " "), F.array_join(two, ""))).otherwise(F.array().cast("array<string>"))
        initials = F.array_join(F.transform(telling, lambda t: F.substring(t, 1, 1)), "")
        return F.concat(F.array(words, F.replace(words, F.lit(" "), F.lit(""))), F.slice(telling, 1, 1), pair, F.array(initials))

    telling = F.filter(F.split(words, " "), lambda t: (t != "") & ~t.isin(ALIAS_STOP_WORDS))
    return F.array_distinct(F.filter(let(telling, forms), lambda a: F.length(a) >= 3))
