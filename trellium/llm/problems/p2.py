"""Addresses of one opening."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trellium.llm.canonical import load_entries
from trellium.llm.openings import opening_groups, same_openings, title_links
from trellium.plans.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return same_openings(table(spark, d, "jobs"), load_entries(table(spark, d, "gazetteer")))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return opening_groups(table(spark, d, "jobs"), load_entries(table(spark, d, "gazetteer")))


def p2_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles within two edits of each other, over all titles without blocks: the trie alone."""
    return title_links(table(spark, d, "jobs"))


def queries():
    return {"p2_found": p2_found, "p2_groups": p2_groups, "p2_titles": p2_titles}


def sql():
    return {
        "p2_titles": """
        WITH t AS (SELECT DISTINCT trim(regexp_replace(translate(lower(title), 'äöüßéèáàíóúñç', 'aouseeaaiounc'), '[^a-z]+', ' ', 'g')) AS t FROM jobs)
        SELECT x.t AS title_a, y.t AS title_b, CAST(levenshtein(x.t, y.t) AS BIGINT) AS distance FROM t x JOIN t y ON x.t < y.t
        WHERE x.t <> '' AND abs(length(x.t) - length(y.t)) <= 2 AND levenshtein(x.t, y.t) <= 2"""
    }
