"""Spellings of one employer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellium.llm.variants import link_employers, pairs_within
from trellium.plans.tables import table


def p6_employers(spark: SparkSession, d: str) -> DataFrame:
    return link_employers(table(spark, d, "jobs"), "company")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs_within(p6_employers(spark, d), "entity", "name", "company_a", "company_b")


def p6_names(spark: SparkSession, d: str) -> DataFrame:
    """Every spelling that names an employer, as the links know it: none is lost, none comes twice."""
    return p6_employers(spark, d).groupBy("name").agg(F.count("*").alias("n_entities"))


def queries():
    return {"p6_found": p6_found, "p6_employers": p6_employers, "p6_names": p6_names}


def sql():
    return {"p6_names": "SELECT DISTINCT company AS name, CAST(1 AS BIGINT) AS n_entities FROM jobs WHERE regexp_matches(company, '[\\p{L}\\p{N}_]')"}
