"""Near-duplicate records: addresses of one opening, and titles within few edits.

Titles are reduced to their telling words; the trie self-join of letter codes
(``llm.trie``) finds those within the edit budget, and words are paired off after
it. Employer and place must mean the same.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellium.llm.canonical import gazetteer_of
from trellium.llm.companies import learn_companies, read_company
from trellium.llm.names import osa_within, skeleton, words
from trellium.llm.trie import BUDGET, EDITS, letter_bits, letter_code, near_codes
from trellium.llm.variants import READ, READ_COLUMNS, components, employer_node, employer_roots, fold_rare
from trellium.session import cut, spread

# Words of a title or a place that tell openings and places not apart.
SENIORITY = {"sr": "senior", "sen": "senior", "snr": "senior", "jr": "junior", "jun": "junior", "jnr": "junior"}
TITLE_NOISE = ["gesucht", "neu", "new", "stellenangebot", "stellenanzeige", "stelle", "job", "unbefristet", "befristet", "vollzeit", "teilzeit", "full", "part", "time", "fulltime", "permanent", "ab", "sofort", "in", "im", "bereich", "als", "wir", "suchen", "std", "stunden", "fur", "for", "den", "die", "der", "das", "a", "the", "und", "and", "of", "all", "genders", "gn", "hiring", "now", "urgent", "dringend"]
PLACE_NOISE = [
    "raum", "region", "grosraum", "grossraum", "grosraum", "greater", "stadt", "city", "nahe", "near", "werk", "standort", "ort", "based", "in", "zentrum", "nord", "sud", "ost", "west", "altstadt", "innenstadt", "gewerbepark", "industriegebiet", "und", "umgebung", "area",
    "homeoffice", "moglich", "hybrid", "remote", "tage", "mobil", "vollzeit", "teilzeit", "de", "at", "ch", "d", "a", "germany", "deutschland", "austria", "osterreich", "schweiz", "switzerland", "office", "home", "buro", "optional", "only", "eu", "fully", "completely", "full", "nur", "rein", "komplett", "vollstandig", "total", "bei", "bezirk", "landkreis", "kreis",
]
ANYWHERE_WORDS = ["remote", "homeoffice", "mobiles arbeiten", "mobile arbeit", "home office", "anywhere", "ortsunabhangig", "bundesweit", "deutschlandweit", "europaweit", "weltweit", "worldwide", "telework", "teletravail", "teletrabajo", "teletrabalho", "praca zdalna", "prace na dalku", "zdalnie", "work from home", "wfh"]
SEVERAL_WORDS = ["verschiedene orte", "verschiedene standorte", "mehrere standorte", "mehrere orte", "siehe anzeige", "standort nach absprache", "nach absprache", "nach vereinbarung", "various locations", "various", "multiple sites", "multiple locations", "several locations", "diverse", "diverse standorte", "unterschiedliche standorte", "flexibel", "flexible", "tbd", "to be determined", "siehe stellenanzeige", "see ad", "plusieurs sites", "varios lugares"]

_GENDER = re.compile(r"[(\[]?\b[mwfdxig](?:\s*[/|,]\s*[mwfdxig*]){1,3}\b[)\]]?|[(\[]?\ball genders\b[)\]]?", re.I)
_FEMININE = re.compile(r"(?<=\w)\s?(?:\(\s*in\s*\)|[*:_/]\s?-?in\b)", re.I)
_NOISE = set(TITLE_NOISE)


def title_words(title: str | None) -> list[str]:
    """Words that tell role, field and seniority, in binary order; abbreviations of seniority written out."""
    if title is None:
        return []
    text = _FEMININE.sub("", _GENDER.sub(" ", title))
    out = []
    for w in words(text):
        w = SENIORITY.get(w, w)
        if w not in _NOISE and not w.isdigit() and len(w) > 1:
            out.append(w)
    return sorted(out)


_PLACE_NOISE = set(PLACE_NOISE)
_ANYWHERE = {tuple(a.split()) for a in ANYWHERE_WORDS}
_ANYWHERE_PARTS = {w for a in _ANYWHERE for w in a}
_SEVERAL = {tuple(a.split()) for a in SEVERAL_WORDS}


def _names(toks: list[str], phrases: set[tuple[str, ...]]) -> bool:
    return any(tuple(toks[i : i + n]) in phrases for n in {len(p) for p in phrases} for i in range(len(toks) - n + 1))


def place_words(location: str | None) -> tuple[str, str]:
    """What a location outside the reference list means: "@anywhere", "@several" or its town
    (joined letters, and the same with digraphs kept); '' for NULL and blanks."""
    if location is None or not location.strip():
        return "", ""
    toks = [w for w in words(location) if not w.isdigit()]
    rest = [w for w in toks if w not in _PLACE_NOISE]
    if _names(toks, _SEVERAL):
        return "@several", "@several"
    if not rest or all(w in _ANYWHERE_PARTS for w in rest):
        if _names(toks, _ANYWHERE):
            return "@anywhere", "@anywhere"
        if not rest:
            return "".join(toks), "".join(toks)
    plain = [w for w in words(location, digraphs=False) if not w.isdigit() and skeleton(w) not in _PLACE_NOISE]
    return "".join(rest), "".join(plain) or "".join(rest)


def same_words(a: list[str], b: list[str], per_word: int = 1, in_all: int = 2) -> bool:
    """Whether the words pair off within the edit budgets."""
    if len(a) != len(b):
        return False
    left = list(b)
    open_words = []
    for w in a:
        if w in left:
            left.remove(w)
        else:
            open_words.append(w)
    spent = 0
    for w in open_words:
        best = None
        for v in left:
            d = osa_within(w, v, 2 if max(len(w), len(v)) >= 8 else per_word)
            if d is not None and (best is None or d < best[0]):
                best = (d, v)
        if best is None:
            return False
        spent += best[0]
        left.remove(best[1])
    return spent <= in_all


def _same_openings_text(a: str, b: str) -> bool:
    return same_words(a.split(" "), b.split(" "))


def linked_texts(records: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Pairs of texts of one block that mean the same, from distinct ``block, text, code``; every text also comes with itself."""
    return near_codes(records, budget, _same_openings_text).unionByName(records.select("block", F.col("text").alias("text_a"), F.col("text").alias("text_b")))


def opening_records(jobs: DataFrame, entries: list) -> DataFrame:
    """Distinct ``url, block, text`` of postings that name employer, place and title.

    The block is employer and place, each under its canonical spelling; the text
    is the title's telling words. Rows without one of the three are left out.
    """
    rows = spread(jobs.select("url", "title", "company", "location")).filter("url is not null and trim(title) <> '' and trim(company) <> '' and trim(location) <> ''")
    fixed = tuple(entries)
    lexicon = learn_companies(rows, "company")

    @F.pandas_udf(f"{READ}, place_id bigint, town string, town_plain string, text string")
    def read(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        gazetteer = gazetteer_of(fixed)
        of_place = lru_cache(100_000)(lambda v: (i, "", "") if (i := gazetteer.resolve(v)) else (0, *place_words(v)))
        of_title = lru_cache(100_000)(lambda v: " ".join(title_words(v)))
        of_company = lru_cache(100_000)(lambda v: read_company(v, lexicon))
        for titles, companies, locations in batches:
            out = []
            for t, c, p in zip(titles, companies, locations):
                out.append((*of_company(c), *of_place(p), of_title(t)))
            yield pd.DataFrame(out, columns=[*READ_COLUMNS, "place_id", "town", "town_plain", "text"])

    known = cut(rows.withColumn("r", read("title", "company", "location")).select("url", "r.*").withColumn("x", employer_node()), "opening-rows")
    known = known.filter("text <> '' and core <> '' and (place_id > 0 or town <> '')")
    employers = employer_roots(known.groupBy(*READ_COLUMNS).agg(F.count("*").alias("n")))
    unlisted = known.filter("place_id = 0").groupBy("town", "town_plain").agg(F.count("*").alias("n"))
    towns = fold_rare(unlisted, "town", "town_plain", F.sum("n")).select(F.col("x").alias("town"), F.col("root").alias("known_town"))
    place = F.when(F.col("place_id") > 0, F.concat(F.lit("#"), F.col("place_id"))).otherwise(F.coalesce("known_town", "town"))
    short = known.select("url", "x", "place_id", F.when(F.col("place_id") == 0, F.col("town")).alias("town"), "text").distinct()
    full = short.join(employers, "x").join(towns, "town", "left")
    return cut(full.select("url", F.concat_ws(" @ ", "root", place).alias("block"), "text").distinct(), "opening-records")


def text_links(records: DataFrame, budget: int = BUDGET) -> DataFrame:
    """``block, text_a, text_b`` of all texts that mean the same, and of every text with itself."""
    texts = records.select("block", "text").distinct()
    bits = letter_bits(texts, "text")
    coded = cut(texts.withColumn("code", letter_code(F.col("text"), bits)), "opening-codes")
    return cut(linked_texts(coded, budget), "opening-links")


def same_openings(jobs: DataFrame, entries: list, budget: int = BUDGET) -> DataFrame:
    """Pairs ``url_a < url_b`` (binary order) of addresses that are one opening.

    NULL and blank fields make no case; repeated rows count once; two rows of one
    address are no pair; an empty table gives an empty result.
    """
    records = opening_records(jobs, entries)
    links = text_links(records, budget)
    left = records.select("block", F.col("text").alias("text_a"), F.col("url").alias("u"))
    right = records.select("block", F.col("text").alias("text_b"), F.col("url").alias("v"))
    pairs = links.join(left, ["block", "text_a"]).join(right, ["block", "text_b"]).filter("u <> v")
    return pairs.select(F.least("u", "v").alias("url_a"), F.greatest("u", "v").alias("url_b")).distinct()


def opening_groups(jobs: DataFrame, entries: list, budget: int = BUDGET) -> DataFrame:
    """One row per address and opening: ``url, opening, representative, n_links``.

    An opening is a class of texts joined by links, directly or through others,
    within one employer and place, so the pairs of ``same_openings`` are among
    its members. ``representative`` is its smallest address in binary order and
    ``n_links`` the number of other texts that the address's text is linked to.
    An address whose rows disagree may be in several openings. Copies of a text
    stay one row each, so a class of any size has as many rows as members.
    """
    records = opening_records(jobs, entries)
    links = text_links(records, budget)
    node = lambda t: F.concat_ws("\x1f", "block", t)
    edges = links.select(node("text_a").alias("a"), node("text_b").alias("b"))
    root = components(edges, "opening-classes").withColumnRenamed("x", "node")
    others = edges.filter("a <> b")
    degree = others.select("a").unionByName(others.select(F.col("b").alias("a"))).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n_links"))
    members = records.select("url", node("text").alias("node")).join(root, "node").join(degree, "node", "left")
    members = cut(members.groupBy("root", "url").agg(F.max(F.coalesce("n_links", F.lit(0).cast("bigint"))).alias("n_links")), "opening-members")
    heads = members.groupBy("root").agg(F.min("url").alias("representative"))
    return members.join(heads, "root").select("url", F.col("root").alias("opening"), "representative", "n_links")


def folded_title(title: Column) -> Column:
    """Letters a to z of a title in lower case, other signs as single spaces."""
    return F.trim(F.regexp_replace(F.translate(F.lower(title), "äöüßéèáàíóúñç", "aouseeaaiounc"), "[^a-z]+", " "))


def title_links(jobs: DataFrame, edits: int = EDITS) -> DataFrame:
    """``title_a, title_b, distance`` of all different folded titles within ``edits`` (insertion, deletion, replacement).

    One trie over all titles, without blocks. NULL and blank titles take no part.
    """
    titles = cut(jobs.select(folded_title(F.col("title")).alias("text")).filter("text <> ''").distinct(), "titles")
    coded = cut(titles.select(F.lit("").alias("block"), "text", letter_code(F.col("text"), letter_bits(titles, "text")).alias("code")), "title-codes")
    near = near_codes(coded, 2 * edits).select("text_a", "text_b", F.levenshtein("text_a", "text_b", edits).cast("bigint").alias("distance"))
    return near.filter("distance >= 0").select(F.col("text_a").alias("title_a"), F.col("text_b").alias("title_b"), "distance")
