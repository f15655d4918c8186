"""Places of free-typed locations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellium.llm.canonical import canonical_id, load_entries
from trellium.operators.keyed import computed
from trellium.plans.tables import table


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    entries = load_entries(table(spark, d, "gazetteer"))
    names = F.broadcast(table(spark, d, "gazetteer").select(F.col("place").alias("location")).distinct())  # no more than load_entries allows
    typed = table(spark, d, "jobs").select("job_id", "location").filter(F.trim("location") != "").join(names, "location", "left_anti")
    return computed(typed, "place_id", canonical_id(F.col("location"), entries))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d).select("job_id", "place_id")


def p3_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Typed values that name no place, and how often."""
    return _mapped(spark, d).filter("place_id = 0").groupBy("location").agg(F.count("*").alias("n_jobs"))


def queries():
    return {"p3_found": p3_found, "p3_unmatched": p3_unmatched}


def sql():
    return {}
