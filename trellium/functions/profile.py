"""Markdown profiles: headings, sections, bullets and what a section is for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trellium.functions.text import split_terms, unique_items

HEADING_BELOW = 80  # characters of a line with a colon at its end

# Words of a section's name and the bucket that they mean, the first bucket that fits; words of a role that are signals of their own.
SECTION_WORDS = {
    "avoid": ["avoid", "exclude", "not target", "non-target", "nicht", "vermeiden", "ausschluss"],
    "role_signal": ["role signal", "target role signal", "fit signal", "suchsignal"],
    "role": ["target role", "desired role", "good fit", "acceptable title", "zielrolle", "rollen", "stellenbezeichnung"],
    "search": ["search", "discovery", "query", "keywords", "such", "suche"],
    "positive": ["skill", "expertise", "experience", "industry", "strong", "theme", "background", "special", "kennt", "branche", "kompetenz"],
}
ROLE_TOKENS = ["procurement", "purchasing", "buyer", "sourcing", "supply chain", "supplier quality", "supplier development", "supplier management", "category", "commodity", "einkauf", "einkäufer", "einkaeufer", "beschaffung", "lieferantenqualität", "lieferantenqualitaet", "lieferantenentwicklung", "lieferantenmanagement", "warengruppe"]
OTHER = "other"

_COLON = r"^[^\-*](?s:.*):$"
_BULLET = r"^\s*(?:[-*•]|\d+[.)])\s+(\S(?s:.*?))\s*$"


def is_heading(line: Column) -> Column:
    """Lines that begin with #, and short ones with a colon at the end that are no bullet."""
    return line.startswith("#") | (line.rlike(_COLON) & (F.length(line) < HEADING_BELOW))


def section_key(line: Column) -> Column:
    """A heading's name in lower case, without signs of emphasis and colons."""
    bare = F.trim(F.replace(F.regexp_replace(line, r"^#+\s*", ""), F.lit("**"), F.lit("")))
    return F.lower(F.regexp_replace(bare, ":+$", ""))


def bullet_text(line: Column) -> Column:
    """Text of a bullet or numbered item; NULL for other lines."""
    return F.nullif(F.regexp_extract(line, _BULLET, 1), F.lit(""))


def bucket(section: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, keys in SECTION_WORDS.items():
        out = out.when(F.exists(F.array(*[F.lit(k) for k in keys]), lambda k: section.contains(k)), name)
    return out.otherwise(OTHER)


def profile_items(profiles: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line_no, section, bucket, term``: terms of every bullet under the section above it, in the order of lines."""
    lines = profiles.select(key, F.posexplode(F.split(text, r"\r\n|\n|\r")).alias("line_no", "raw")).select(key, "line_no", F.trim(F.regexp_replace("raw", r"^\s+|\s+$", "")).alias("line")).filter("line <> ''")
    head = is_heading(F.col("line"))
    above = Window.partitionBy(key).orderBy("line_no")  # lines of one profile
    filled = lines.withColumn("section", F.coalesce(F.last(F.when(head, section_key(F.col("line"))), ignorenulls=True).over(above), F.lit("")))
    items = filled.filter(~head).select(key, "line_no", "section", bullet_text(F.col("line")).alias("item")).filter("item is not null")
    return items.select(key, "line_no", "section", bucket(F.col("section")).alias("bucket"), F.posexplode(split_terms("item")).alias("term_no", "term"))


def profile_lists(items: DataFrame, key: str) -> DataFrame:
    """One row per profile with the five term lists, first spellings kept, in the order of lines."""
    own = items.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line_no", "term_no", "bucket", "term"))).alias("all"))
    of = lambda *names: F.transform(F.filter("all", lambda x: x["bucket"].isin(*names)), lambda x: x["term"])
    roles = of("role")
    derived = F.flatten(F.transform(roles, lambda r: F.filter(F.array(*[F.lit(t) for t in ROLE_TOKENS]), lambda t: F.lower(r).contains(t))))
    made = own.select(key, unique_items(roles).alias("target_roles"), unique_items(F.concat(of("role", "role_signal"), derived)).alias("role_signals"), unique_items(F.concat(of("positive"), of("search", OTHER))).alias("positive_terms"), unique_items(of("avoid")).alias("avoid_terms"), of("search", OTHER).alias("searched"))
    return made.select(key, "target_roles", "role_signals", "positive_terms", "avoid_terms", unique_items(F.concat("searched", "target_roles", "positive_terms")).alias("search_terms"))
