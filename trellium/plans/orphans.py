"""Problem 5: references to pages that are absent or visited only later."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellium.functions.urls import clean_url, strip
from trellium.operators.orphans import orphan_references, orphan_report
from trellium.plans.sqlgen import clean_url_sql, strip_sql
from trellium.plans.tables import table
from trellium.session import spread

_HTTP = r"(?i)^\s*https?://"


def _key(col: str):
    """The cleaned address; one that cleaning rejects is kept as typed, for no page can equal it."""
    return F.coalesce(clean_url(col), strip(col))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    def refs(name: str, id_col: str, ref: str, at: str) -> DataFrame:
        t = spread(table(spark, d, name).select(id_col, ref, at).filter(F.col(ref).rlike(_HTTP)))
        return t.select(F.lit(name).alias("ref_table"), F.col(id_col).alias("ref_id"), _key(ref).alias("key"), F.col(at).alias("at"))

    pages = spread(table(spark, d, "pages").select("url", "final_url", "visited_at"))
    parents = pages.select(F.explode(F.array_distinct(F.array("url", "final_url"))).alias("url"), F.col("visited_at").alias("at"))
    parents = parents.select(clean_url("url").alias("key"), "at")
    return orphan_references([refs("jobs", "job_id", "source_page", "first_seen_at"), refs("frontier", "item_id", "discovered_from", "queued_at")], parents)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "ref_id", "ref_state")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d))


def _found_sql() -> str:
    def refs(name: str, id_col: str, ref: str, at: str) -> str:
        return f"SELECT '{name}' AS ref_table, CAST({id_col} AS BIGINT) AS ref_id, {ref} AS raw, {at} AS at_time FROM {name} WHERE regexp_matches({ref}, '{_HTTP}')"

    return f"""
    WITH refs AS ({refs("jobs", "job_id", "source_page", "first_seen_at")} UNION ALL {refs("frontier", "item_id", "discovered_from", "queued_at")}),
    raws AS (SELECT DISTINCT raw FROM refs UNION SELECT url FROM pages UNION SELECT final_url FROM pages),
    cleaned AS (SELECT raw, {clean_url_sql("raw")} AS cleaned FROM raws),
    visits AS (SELECT url AS raw, visited_at FROM pages UNION ALL SELECT final_url, visited_at FROM pages),
    parents AS (SELECT c.cleaned AS k, min(v.visited_at) AS first_visit FROM visits v JOIN cleaned c ON c.raw = v.raw WHERE c.cleaned IS NOT NULL GROUP BY 1),
    keyed AS (SELECT r.*, coalesce(c.cleaned, {strip_sql("r.raw")}) AS k FROM refs r JOIN cleaned c ON c.raw = r.raw)
    SELECT ref_table, ref_id, CASE WHEN p.k IS NULL THEN 'missing' ELSE 'late' END AS ref_state, at_time
    FROM keyed LEFT JOIN parents p ON p.k = keyed.k
    WHERE p.k IS NULL OR p.first_visit > at_time"""


def queries():
    return {"p5_found": p5_found, "p5_report": p5_report}


def sql() -> dict[str, str]:
    found = _found_sql()
    return {
        "p5_found": f"SELECT ref_table, ref_id, ref_state FROM ({found})",
        "p5_report": f"SELECT ref_table, strftime(at_time, '%Y-%m') AS month, ref_state, count(*) AS n_refs FROM ({found}) GROUP BY 1, 2, 3",
    }
