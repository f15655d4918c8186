"""Distances on the sphere and nearest places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellium.functions.text import folded, transliterated

EARTH_KM = 6371.0088
MAX_PLACES = 10_000


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def _words(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"[^\p{L}\p{N}_]+", " "))


def named_places(texts: DataFrame, text: str, gazetteer: DataFrame, lat: float, lon: float, place: str = "place") -> DataFrame:
    """``text, place, distance_km`` for every place that a distinct text names, with its distance to a centre.

    A place must stand as words of its own, in its own spelling or with umlauts
    written out. The gazetteer (``place, lat, lon``) is refused beyond its
    bound; its names meet a text's words by their first word in a broadcast
    join, and only then the whole name is looked for.
    """
    if (n := gazetteer.count()) > MAX_PLACES:
        raise ValueError(f"{n} places, at most {MAX_PLACES}")
    known = gazetteer.filter(F.col(place).isNotNull()).select(F.col(place).alias("place"), haversine_km(F.lit(float(lat)), F.lit(float(lon)), F.col("lat"), F.col("lon")).alias("distance_km"), F.explode(F.array_distinct(F.array(_words(folded(place)), _words(transliterated(place))))).alias("form"))
    known = known.filter("form <> ''").withColumn("word", F.element_at(F.split("form", " "), 1))
    both = F.concat(F.lit(" "), _words(folded("text")), F.lit(" | "), _words(transliterated("text")), F.lit(" "))
    rows = texts.filter(F.col(text).isNotNull()).select(F.col(text).alias("text")).distinct().select("text", both.alias("hay"))
    words = rows.select("text", "hay", F.explode(F.array_distinct(F.split(F.trim("hay"), " "))).alias("word"))
    met = words.join(F.broadcast(known), "word").filter(F.contains("hay", F.concat(F.lit(" "), "form", F.lit(" "))))
    return met.select(F.col("text").alias(text), "place", "distance_km").distinct()
