"""Documents decoded in a wrong character encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellium.llm.mojibake import examined, is_garbled
from trellium.operators.keyed import computed
from trellium.plans.tables import table
from trellium.session import spread


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    docs = computed(spread(table(spark, d, "documents").select("doc_id", "text")), "garbled", is_garbled(F.col("text")))
    return docs.filter("garbled").select("doc_id")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    docs = computed(spread(table(spark, d, "documents").select("doc_id", "text")), "x", examined(F.col("text")))
    return docs.filter("x.garbled").select("doc_id", "x.restored")


def queries():
    return {"p10_found": p10_found, "p10_restored": p10_restored}


def sql():
    return {}
