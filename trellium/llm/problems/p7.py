"""Pages whose title is residue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellium.llm.residue import is_residue
from trellium.plans.tables import table


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", "title").filter(is_residue(F.col("title"))).select("page_id")


def queries():
    return {"p7_found": p7_found}


def sql():
    return {}
