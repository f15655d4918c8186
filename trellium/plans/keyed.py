"""Stored tables: upserts, lookups, queue, counts and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellium.operators.keyed import capped, explode_keys, insert_new, last_write, ranked, upsert
from trellium.plans.tables import table

_JOB_COLUMNS = ["title", "company", "location", "posting_language", "fit_score", "score_source", "score_basis", "reason", "evidence", "source_page", "source_key", "first_seen_at", "last_seen_at"]
_SPLIT = "2025-07-01 00:00:00"


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").select("job_id", "url", *_JOB_COLUMNS)


def jobs_latest(spark: SparkSession, d: str) -> DataFrame:
    """The log folded to one row per address: the last save, with the first time it was seen."""
    order = F.struct(F.coalesce(F.unix_micros(F.col("last_seen_at").cast("timestamp")), F.lit(-(1 << 62))), "job_id")
    return last_write(_log(spark, d), "url", order, {"first_seen_at": F.min("first_seen_at")})


def jobs_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Saves of the second half of the year over those of the first; the first time stays."""
    order = F.struct("first_seen_at", "job_id")
    log = _log(spark, d)
    early, late = (last_write(log.filter(f"first_seen_at {op} timestamp_ntz'{_SPLIT}'"), "url", order) for op in ("<", ">="))
    return upsert(early, late, "url", ["first_seen_at"]).select("url", "job_id", "fit_score", "first_seen_at")


def pages_two_keys(spark: SparkSession, d: str) -> DataFrame:
    """Every visit stored under its address and its final address; the last visit wins."""
    rows = explode_keys(table(spark, d, "pages"), ["url", "final_url"], "address").select("address", "page_id", "status", "visited_at")
    return last_write(rows, "address", F.struct("visited_at", "page_id"))


def page_status_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Status of each queued address: of its own page, else of a page that ended there."""
    pages = table(spark, d, "pages")
    own = pages.select(F.col("url").alias("address"), F.lit(1).alias("rank"), "visited_at", "page_id", "status")
    ended = pages.select(F.col("final_url").alias("address"), F.lit(0).alias("rank"), "visited_at", "page_id", "status")
    known = own.unionByName(ended).groupBy("address").agg(F.max_by("status", F.struct("rank", "visited_at", "page_id")).alias("page_status"))
    queue = table(spark, d, "frontier").select("item_id", "url")
    return queue.join(known, queue["url"] == known["address"], "left").select("item_id", "page_status")


def unvisited(spark: SparkSession, d: str) -> DataFrame:
    """Queue entries whose address no page has."""
    known = explode_keys(table(spark, d, "pages").select("url", "final_url"), ["url", "final_url"], "address").select("address").distinct()
    queue = table(spark, d, "frontier").select("item_id", "url")
    return queue.join(known, queue["url"] == known["address"], "left_anti")


def sources_ensured(spark: SparkSession, d: str) -> DataFrame:
    """Source memory with a fresh row for each source that only the queue knows."""
    memory = table(spark, d, "source_memory").select("source_key", "score", "visits")
    fresh = table(spark, d, "frontier").filter("source_key is not null").select("source_key").distinct()
    return insert_new(memory, fresh.select("source_key", F.lit(50.0).alias("score"), F.lit(0).cast("bigint").alias("visits")), "source_key")


def frontier_merged(spark: SparkSession, d: str) -> DataFrame:
    """Repeated queue entries as one: highest priority, least depth, latest reason, first parent and time."""
    q = table(spark, d, "frontier").filter("url is not null")
    at = F.struct("queued_at", "item_id")
    return q.groupBy("url").agg(
        F.max("priority").alias("priority"), F.min("depth").alias("depth"), F.max_by("reason", at).alias("reason"), F.min_by("discovered_from", at).alias("discovered_from"), F.min("queued_at").alias("queued_at"), F.count("*").alias("n_entries")
    )


def frontier_pop(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "frontier").filter("status = 'queued'").select("item_id", "url", "priority", "queued_at")
    return ranked(q, [F.desc_nulls_last("priority"), F.asc("queued_at"), F.asc("item_id")], 50)


def frontier_priority(spark: SparkSession, d: str) -> DataFrame:
    """Priority of an entry from its source's score, its depth and its reason, without jitter."""
    memory = table(spark, d, "source_memory").select("source_key", "score")
    q = table(spark, d, "frontier").select("item_id", "source_key", "depth", "reason").join(memory, "source_key", "left")
    has_reason = F.when(F.coalesce(F.trim("reason"), F.lit("")) != "", 1.0).otherwise(0.0)
    return q.select("item_id", (F.coalesce("score", F.lit(50.0)) * 1.0 - F.coalesce(F.col("depth"), F.lit(0)) * 7.0 + has_reason * 2.5).alias("priority"))


def source_cap(spark: SparkSession, d: str) -> DataFrame:
    """Queue entries that fit under 25 visits of their source, best first."""
    visits = table(spark, d, "source_memory").select("source_key", "visits")
    q = table(spark, d, "frontier").filter("source_key is not null").select("item_id", "source_key", "priority").join(visits, "source_key", "left")
    return capped(q, "source_key", F.lit(25) - F.coalesce("visits", F.lit(0)), [F.desc_nulls_last("priority"), F.asc("item_id")], 25).select("item_id", "source_key")


def parent_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Queue entries with the title of the page they came from; of several visits the last."""
    parents = table(spark, d, "pages").groupBy("url").agg(F.max_by("title", F.struct("visited_at", "page_id")).alias("parent_title"), F.count("*").alias("n_visits"))
    q = table(spark, d, "frontier").select("item_id", "discovered_from")
    return q.join(parents, q["discovered_from"] == parents["url"], "left").select("item_id", "parent_title", F.coalesce("n_visits", F.lit(0)).alias("n_visits"))


def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "frontier").groupBy("status").agg(F.count("*").alias("n_items"))


def run_counters(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    quality = F.least(F.greatest(F.col("source_quality"), F.lit(0)), F.lit(100))
    return p.agg(
        F.count("*").alias("pages"),
        F.sum(F.greatest(F.coalesce("jobs_found", F.lit(0)), F.lit(0))).alias("jobs_seen"),
        F.sum(F.greatest(F.coalesce("high_fit_jobs", F.lit(0)), F.lit(0))).alias("high_fit"),
        F.count_if(F.col("status") == "blocked_by_robots").alias("blocked"),
        F.count_if(F.col("status").startswith("error")).alias("errors"),
        F.coalesce(F.avg(F.when(F.col("source_quality") > 0, quality)), F.lit(0.0)).alias("average_quality"),
    )


def high_fit_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").groupBy("source_key").agg(F.count_if(F.col("fit_score") >= 80).alias("n_high_fit"), F.count("*").alias("n_jobs"))


def export_rows(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d).select("fit_score", "title", "company", "location", "url", "posting_language", "score_source", "source_key", "first_seen_at", "last_seen_at").orderBy(F.desc("fit_score"), F.desc("last_seen_at"), F.asc("url"))


def recent_jobs(spark: SparkSession, d: str) -> DataFrame:
    return ranked(_log(spark, d).select("job_id", "url", "last_seen_at"), [F.desc_nulls_last("last_seen_at"), F.asc("job_id")], 25)


def recent_queries(spark: SparkSession, d: str) -> DataFrame:
    """Search queries by their use in this and earlier runs."""
    return table(spark, d, "queries").select("query", (F.coalesce("uses", F.lit(0)) + 1).alias("uses"), F.coalesce("last_used_at", "created_at").alias("touched_at"))


def source_job_share(spark: SparkSession, d: str) -> DataFrame:
    """Saved postings per source beside the source's own count."""
    saved = table(spark, d, "jobs").filter("source_key is not null").groupBy("source_key").agg(F.count_distinct("url").alias("n_saved"))
    memory = table(spark, d, "source_memory").select("source_key", "jobs_found", "score")
    return memory.join(saved, "source_key", "full").select("source_key", "jobs_found", "score", F.coalesce("n_saved", F.lit(0)).alias("n_saved"))


def queries():
    return {
        "jobs_latest": jobs_latest, "jobs_upsert_first_seen": jobs_upsert, "pages_replace_two_keys": pages_two_keys, "page_status_lookup": page_status_lookup, "unvisited_frontier": unvisited, "sources_ensured": sources_ensured,
        "frontier_merge": frontier_merged, "frontier_pop_topk": frontier_pop, "frontier_priority": frontier_priority, "source_visit_cap": source_cap, "parent_lookup": parent_lookup, "status_counts": status_counts,
        "run_counters": run_counters, "high_fit_count": high_fit_count, "export_rows": export_rows, "recent_jobs": recent_jobs, "query_usage": recent_queries, "source_job_share": source_job_share,
    }


def sql() -> dict[str, str]:
    others = ", ".join(c for c in _JOB_COLUMNS if c != "first_seen_at")
    return {
        "jobs_latest": f"""SELECT url, job_id, {others}, first_seen_at FROM (SELECT job_id, url, {others}, min(first_seen_at) OVER (PARTITION BY url) AS first_seen_at,
            row_number() OVER (PARTITION BY url ORDER BY last_seen_at DESC NULLS LAST, job_id DESC) AS r FROM jobs) WHERE r = 1""",
        "jobs_upsert_first_seen": f"""WITH k AS (SELECT *, first_seen_at >= TIMESTAMP '{_SPLIT}' AS late FROM jobs),
            r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url, late ORDER BY first_seen_at DESC, job_id DESC) AS n FROM k) WHERE n = 1)
            SELECT url, max_by(job_id, late) AS job_id, (list(fit_score ORDER BY late DESC))[1] AS fit_score, (list(first_seen_at ORDER BY late))[1] AS first_seen_at FROM r GROUP BY url""",
        "pages_replace_two_keys": """WITH a AS (SELECT url AS address, * FROM pages UNION ALL SELECT final_url, * FROM pages WHERE final_url <> url)
            SELECT address, page_id, status, visited_at FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY visited_at DESC, page_id DESC) AS r FROM a) WHERE r = 1""",
        "page_status_lookup": """WITH a AS (SELECT url AS address, 1 AS k, visited_at, page_id, status FROM pages UNION ALL SELECT final_url, 0, visited_at, page_id, status FROM pages),
            b AS (SELECT address, status FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY k DESC, visited_at DESC, page_id DESC) AS r FROM a) WHERE r = 1)
            SELECT item_id, b.status AS page_status FROM frontier LEFT JOIN b ON b.address = frontier.url""",
        "unvisited_frontier": "SELECT item_id, url FROM frontier f WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.url = f.url) AND NOT EXISTS (SELECT 1 FROM pages p WHERE p.final_url = f.url)",
        "sources_ensured": "SELECT source_key, score, visits FROM source_memory UNION ALL SELECT DISTINCT source_key, CAST(50 AS DOUBLE), CAST(0 AS BIGINT) FROM frontier WHERE source_key IS NOT NULL AND source_key NOT IN (SELECT source_key FROM source_memory)",
        "frontier_merge": """SELECT url, max(priority) AS priority, min(depth) AS depth, (list(reason ORDER BY queued_at DESC, item_id DESC))[1] AS reason, (list(discovered_from ORDER BY queued_at, item_id))[1] AS discovered_from,
            min(queued_at) AS queued_at, count(*) AS n_entries FROM frontier WHERE url IS NOT NULL GROUP BY url""",
        "frontier_pop_topk": "SELECT item_id, url, priority, queued_at FROM frontier WHERE status = 'queued' ORDER BY priority DESC NULLS LAST, queued_at, item_id LIMIT 50",
        "frontier_priority": """SELECT item_id, coalesce(score, CAST(50 AS DOUBLE)) - coalesce(depth, 0) * CAST(7 AS DOUBLE) + CASE WHEN coalesce(trim(reason), '') <> '' THEN CAST(2.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS priority
            FROM frontier LEFT JOIN source_memory USING (source_key)""",
        "source_visit_cap": """SELECT item_id, source_key FROM (SELECT item_id, source_key, coalesce(visits, 0) AS v, row_number() OVER (PARTITION BY source_key ORDER BY priority DESC NULLS LAST, item_id) AS r
            FROM frontier LEFT JOIN source_memory USING (source_key) WHERE source_key IS NOT NULL) WHERE r <= 25 - v""",
        "parent_lookup": """WITH p AS (SELECT url, (list(title ORDER BY visited_at DESC, page_id DESC))[1] AS parent_title, count(*) AS n FROM pages GROUP BY url)
            SELECT item_id, parent_title, coalesce(n, 0) AS n_visits FROM frontier LEFT JOIN p ON p.url = frontier.discovered_from""",
        "status_counts": "SELECT status, count(*) AS n_items FROM frontier GROUP BY status",
        "run_counters": """SELECT count(*) AS pages, CAST(sum(greatest(coalesce(jobs_found, 0), 0)) AS BIGINT) AS jobs_seen, CAST(sum(greatest(coalesce(high_fit_jobs, 0), 0)) AS BIGINT) AS high_fit,
            count(*) FILTER (WHERE status = 'blocked_by_robots') AS blocked, count(*) FILTER (WHERE starts_with(status, 'error')) AS errors,
            coalesce(avg(CASE WHEN source_quality > 0 THEN least(greatest(source_quality, 0), 100) END), 0) AS average_quality FROM pages""",
        "high_fit_count": "SELECT source_key, count(*) FILTER (WHERE fit_score >= 80) AS n_high_fit, count(*) AS n_jobs FROM jobs GROUP BY source_key",
        "export_rows": "SELECT fit_score, title, company, location, url, posting_language, score_source, source_key, first_seen_at, last_seen_at FROM jobs ORDER BY fit_score DESC, last_seen_at DESC, url",
        "recent_jobs": "SELECT job_id, url, last_seen_at FROM jobs ORDER BY last_seen_at DESC NULLS LAST, job_id LIMIT 25",
        "query_usage": "SELECT query, coalesce(uses, 0) + 1 AS uses, coalesce(last_used_at, created_at) AS touched_at FROM queries",
        "source_job_share": """WITH s AS (SELECT source_key, count(DISTINCT url) AS n FROM jobs WHERE source_key IS NOT NULL GROUP BY 1)
            SELECT source_key, jobs_found, score, coalesce(n, 0) AS n_saved FROM source_memory FULL JOIN s USING (source_key)""",
    }
