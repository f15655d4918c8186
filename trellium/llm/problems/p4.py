"""Top rows of every source key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellium.llm.topn import top_n_per_group
from trellium.plans.tables import table

N = 5


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "jobs").select("source_key", "job_id", "fit_score", "last_seen_at")
    code = [F.col("fit_score"), F.unix_micros(F.col("last_seen_at").cast("timestamp")), -F.col("job_id")]
    return top_n_per_group(jobs, "source_key", code, N, ["job_id"])


def queries():
    return {"p4_found": p4_found}


def sql():
    return {
        "p4_found": f"""SELECT source_key, job_id FROM (SELECT source_key, job_id, row_number() OVER (
          PARTITION BY source_key ORDER BY fit_score DESC, last_seen_at DESC NULLS LAST, job_id) AS r
          FROM jobs WHERE source_key IS NOT NULL AND fit_score IS NOT NULL) WHERE r <= {N}"""
    }
