"""Postings in embedded data.

Every object of the wanted kind is shredded into its leaves, texts with the path
that leads to them, whatever its depth and shape. What a leaf means is said by
expressions over paths alone, after the schema.org vocabulary.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from trellium.functions.urls import let, resolve

# Characters kept of each field of a posting.
LIMITS = {"title": 300, "company": 200, "location": 200, "url": 1500, "description": 4000, "employment_type": 120, "date_posted": 80, "valid_through": 80}
#: Fields that are the text below one key.
PLAIN_FIELDS = {"title": "title", "description": "description", "employment_type": "employmentType", "date_posted": "datePosted", "valid_through": "validThrough"}
ADDRESS_FIELDS = ["addressLocality", "addressRegion", "addressCountry"]
TEXT_HEAD, TEXT_MOST = "STRUCTURED JOBPOSTING DATA:", 20
LEAVES = "array<array<struct<path:string,leaf:string>>>"


def _children(node, path: str):
    if isinstance(node, dict):
        return [(v, f"{path}/{k}" if path else k) for k, v in node.items()]
    return [(v, f"{path}[{i}]") for i, v in enumerate(node)]


def shredded(node) -> list[tuple[str, str]]:
    """(path, text) of the non-blank leaves in document order; array places are in brackets. Without recursion, so depth does not matter."""
    out, open_nodes = [], [(node, "")]
    while open_nodes:
        at, path = open_nodes.pop()
        if isinstance(at, (dict, list)):
            open_nodes += _children(at, path)[::-1]
        elif at is not None and (text := str(at).strip()):
            out.append((path, text))
    return out


def objects_of(text: str, kind: str) -> list[dict]:
    """Objects of a kind at any depth, outer before inner; none where the text does not parse."""
    try:
        open_nodes = [json.loads(text)]
    except (ValueError, RecursionError, TypeError):
        return []
    out = []
    while open_nodes:
        at = open_nodes.pop()
        if isinstance(at, dict):
            named = at.get("@type") or at.get("type") or ()
            if kind in {str(n).lower() for n in (named if isinstance(named, list) else [named])}:
                out.append(at)
        if isinstance(at, (dict, list)):
            open_nodes += [v for v, _ in _children(at, "")][::-1]
    return out


def embedded_leaves(raws: Column, kind: str = "jobposting") -> Column:
    """The leaves of each object of a kind in an array of JSON texts."""

    @F.pandas_udf(LEAVES)
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([[[{"path": p, "leaf": x} for p, x in shredded(o)] for t in (texts if texts is not None else ()) for o in objects_of(t, kind)] for texts in pages], dtype=object)

    return run(raws)


def text_below(leaves: Column, path: Column | str) -> Column:
    """Texts at and below a path, joined by commas; '' if there are none."""
    p = F.lit(path) if isinstance(path, str) else path
    mine = F.filter(leaves, lambda x: (x["path"] == p) | x["path"].startswith(F.concat(p, F.lit("/"))) | x["path"].startswith(F.concat(p, F.lit("["))))
    return F.array_join(F.transform(mine, lambda x: x["leaf"]), ", ")


def _first_filled(*texts: Column) -> Column:
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], F.lit(""))


def _address(leaves: Column, at: Column) -> Column:
    """Town, region and country below a path; the text there where it is no object."""
    inner = F.concat(at, F.lit("/"))
    parts = F.filter(F.array(*[text_below(leaves, F.concat(inner, F.lit(f))) for f in ADDRESS_FIELDS]), lambda t: t != "")
    return F.when(F.exists(leaves, lambda x: x["path"].startswith(inner)), F.array_join(parts, ", ")).otherwise(text_below(leaves, at))


def _places(leaves: Column) -> Column:
    heads = F.array_distinct(F.filter(F.transform(leaves, lambda x: F.regexp_extract(x["path"], r"^jobLocation(\[\d+\])?(?=$|[/\[])", 0)), lambda h: h != ""))

    def place(head: Column) -> Column:
        inner = F.concat(head, F.lit("/address"))
        return F.when(F.exists(leaves, lambda x: x["path"].startswith(inner) & x["path"].rlike(r"^jobLocation(\[\d+\])?/address($|[/\[])")), _address(leaves, inner)).otherwise(_address(leaves, head))

    return F.array_join(F.array_distinct(F.filter(F.transform(heads, place), lambda t: t != "")), "; ")


def posting(leaves: Column, base: Column) -> Column:
    """struct of a posting's fields, each cut to its limit."""
    fields = {name: text_below(leaves, key) for name, key in PLAIN_FIELDS.items()}
    employer = "hiringOrganization"
    fields["company"] = _first_filled(text_below(leaves, f"{employer}/name"), text_below(leaves, f"{employer}/legalName"), text_below(leaves, employer))
    fields["location"] = _places(leaves)
    fields["url"] = let(_first_filled(text_below(leaves, "url"), text_below(leaves, "sameAs"), base), lambda u: F.when(u == "", u).otherwise(F.coalesce(resolve(base, u), u)))
    return F.struct(*[F.substring(fields[name], 1, n).alias(name) for name, n in LIMITS.items()])


def json_ld_postings(leaves: Column, base: Column) -> Column:
    """Postings of a page from their leaves: those with title and address, the first of equal ones (title in any case, address)."""
    made = F.filter(F.transform(leaves, lambda one: posting(one, base)), lambda p: (p["title"] != "") & (p["url"] != ""))
    key = lambda p: F.struct(F.lower(p["title"]), p["url"])
    return let(made, lambda a: F.filter(a, lambda p, i: F.array_position(F.transform(a, key), key(p)) == i + 1))


def postings_text(postings: Column, most: int = TEXT_MOST) -> Column:
    """Numbered text of the first postings with the fields that they have; '' without any."""
    shown = [("company", "Company"), ("location", "Location"), ("employment_type", "Employment type"), ("url", "URL")]

    def lines(p: Column, i: Column) -> Column:
        head = F.concat((i + 1).cast("string"), F.lit(". Title: "), p["title"])
        return F.concat_ws("\n", head, *[F.when(p[f] != "", F.concat(F.lit(f"   {label}: "), p[f])) for f, label in shown])

    return F.when(F.size(postings) > 0, F.concat_ws("\n", F.lit(TEXT_HEAD), F.transform(F.slice(postings, 1, most), lines))).otherwise("")


def with_embedded(text: Column, postings: Column) -> Column:
    """Page text followed by the text of its embedded postings."""
    return F.concat_ws("\n\n", F.nullif(text, F.lit("")), F.nullif(postings_text(postings), F.lit("")))
