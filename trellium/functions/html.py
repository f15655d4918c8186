"""Links and embedded data of HTML text, by expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ANCHOR = r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"
_JSON_LD = r"(?is)<script[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"


def plain_text(html: Column) -> Column:
    """Tags off, frequent entities decoded, white space collapsed."""
    t = F.regexp_replace(html, r"(?is)<[^>]+>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def anchors(html: Column, most: int = 400) -> Column:
    """array<struct<href, text>> of the first anchors with an address, in their order."""
    whole = F.regexp_extract_all(html, F.lit(_ANCHOR), F.lit(0))
    parts = F.transform(whole, lambda a: F.struct(F.regexp_extract(a, _ANCHOR, 1).alias("href"), plain_text(F.regexp_extract(a, _ANCHOR, 2)).alias("text")))
    return F.slice(F.filter(parts, lambda p: p["href"] != ""), 1, most)


def json_ld(html: Column) -> Column:
    """Non-empty bodies of the embedded data scripts."""
    return F.filter(F.transform(F.regexp_extract_all(html, F.lit(_JSON_LD), F.lit(1)), lambda s: F.trim(s)), lambda s: s != "")
