"""The queue: admission, popping, marking, clearing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellium.operators.frontier import FIELDS, admit, decisions, entries, marked, page_statuses, pop_and_mark, waiting
from trellium.operators.keyed import explode_keys
from trellium.plans.tables import table

#: Entries from then on are the batch of candidates, those before the queue that they meet.
BATCH_FROM = "2025-09-01 00:00:00"
NOW = "2026-03-01 00:00:00"
POPPED, CAP = 50, 25
_TURN = ["queued_at", "item_id"]


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "frontier").select("item_id", "url", *FIELDS)


def _queue(spark: SparkSession, d: str) -> DataFrame:
    return entries(_log(spark, d).filter(F.col("queued_at") < F.lit(BATCH_FROM).cast("timestamp_ntz")), _TURN)


def _decided(spark: SparkSession, d: str) -> DataFrame:
    batch = _log(spark, d).filter(F.col("queued_at") >= F.lit(BATCH_FROM).cast("timestamp_ntz"))
    return decisions(batch, page_statuses(table(spark, d, "pages"), ["visited_at", "page_id"]), table(spark, d, "source_memory"))


def frontier_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Each candidate of the batch with what admission says of it."""
    return _decided(spark, d).select("item_id", "decision")


def frontier_admission(spark: SparkSession, d: str) -> DataFrame:
    """The queue after the batch."""
    return admit(_queue(spark, d), _decided(spark, d).filter("decision = 'admitted'"), _TURN)


def frontier_pop_marked(spark: SparkSession, d: str) -> DataFrame:
    """All entries after the next fifty have become active."""
    return pop_and_mark(_log(spark, d), POPPED, F.lit(NOW).cast("timestamp_ntz"), "item_id").select("item_id", "status", "updated_at")


def frontier_marked(spark: SparkSession, d: str) -> DataFrame:
    """Active entries with the outcome of their page: done, blocked or error."""
    pages = page_statuses(table(spark, d, "pages"), ["visited_at", "page_id"])
    state = F.when(F.col("page_status") == "ok", "done").when(F.col("page_status") == "blocked_by_robots", "blocked").otherwise("error")
    active = _log(spark, d).filter("status = 'active'").join(pages, "url").select("item_id", state.alias("status"), F.lit(NOW).cast("timestamp_ntz").alias("at"))
    return marked(_log(spark, d), active, "item_id").select("item_id", "status", "updated_at")


def frontier_waiting(spark: SparkSession, d: str) -> DataFrame:
    """The queue without what has left it."""
    return waiting(_log(spark, d)).select("item_id", "url", "priority")


def frontier_reset(spark: SparkSession, d: str) -> DataFrame:
    """Entries that emptying the queue deletes, and those that stay."""
    log = _log(spark, d)
    return log.agg(F.count("*").alias("n_deleted")).crossJoin(log.limit(0).agg(F.count("*").alias("n_left")))


def source_visits_set(spark: SparkSession, d: str) -> DataFrame:
    """Source memory with the visits of the sources in the queue set to the cap."""
    stuck = table(spark, d, "frontier").filter("status = 'skipped_source_limit'").select("source_key").distinct().withColumn("_n", F.lit(CAP).cast("bigint"))
    return table(spark, d, "source_memory").join(stuck, "source_key", "left").select("source_key", F.coalesce("_n", "visits").alias("visits"))


def jobs_on_pages(spark: SparkSession, d: str) -> DataFrame:
    """Saved postings whose source is one of the visited pages (left semi)."""
    known = explode_keys(table(spark, d, "pages").select("url", "final_url"), ["url", "final_url"], "address").select("address").distinct()
    jobs = table(spark, d, "jobs").select("job_id", "source_page")
    return jobs.join(known, jobs["source_page"] == known["address"], "left_semi")


def query_uses(spark: SparkSession, d: str) -> DataFrame:
    """Search queries after a log of uses: counts added, last use touched."""
    q = table(spark, d, "queries").select("query", "uses", F.col("last_used_at").cast("timestamp_ntz").alias("last_used_at"))
    used = table(spark, d, "frontier").filter("reason is not null and queued_at is not null").select(F.col("reason").alias("query"), "queued_at")
    named = used.unionByName(q.select("query", "last_used_at").withColumnRenamed("last_used_at", "queued_at").filter("queued_at is not null"))
    counted = named.groupBy("query").agg(F.count("*").alias("n"), F.max(F.col("queued_at").cast("timestamp_ntz")).alias("at"))
    return q.join(counted, "query", "left").select("query", (F.coalesce("uses", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("bigint").alias("uses"), F.coalesce("at", "last_used_at").alias("last_used_at"))


def queries():
    return {
        "frontier_decisions": frontier_decisions, "frontier_admission": frontier_admission, "frontier_pop_marked": frontier_pop_marked, "frontier_marked": frontier_marked, "frontier_waiting": frontier_waiting,
        "frontier_reset": frontier_reset, "source_visits_set": source_visits_set, "jobs_on_pages": jobs_on_pages, "query_uses": query_uses,
    }


def sql() -> dict[str, str]:
    statuses = """s AS (SELECT url, status FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY own DESC, visited_at DESC, page_id DESC) AS r FROM
        (SELECT url, 1 AS own, visited_at, page_id, coalesce(status, '') AS status FROM pages UNION ALL SELECT final_url, 0, visited_at, page_id, coalesce(status, '') FROM pages)) WHERE r = 1)"""
    decided = f"""{statuses},
        b AS (SELECT f.*, CASE WHEN s.status = 'blocked_by_robots' OR starts_with(s.status, 'error:') THEN 'admitted' WHEN s.status IS NOT NULL THEN 'visited'
            WHEN coalesce(m.visits, 0) >= 25 THEN 'source_full' WHEN coalesce(m.score, 50) <= 8 THEN 'source_weak' ELSE 'admitted' END AS decision
          FROM frontier f LEFT JOIN s ON s.url = f.url LEFT JOIN source_memory m ON m.source_key = f.source_key WHERE f.url IS NOT NULL AND f.queued_at >= TIMESTAMP '{BATCH_FROM}')"""
    return {
        "frontier_decisions": f"WITH {decided} SELECT item_id, decision FROM b",
        "frontier_admission": f"""WITH {decided},
          o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY queued_at DESC, item_id DESC) AS r FROM frontier WHERE url IS NOT NULL AND queued_at < TIMESTAMP '{BATCH_FROM}') WHERE r = 1),
          c AS (SELECT url, (list(struct_pack(discovered_from, source_key, queued_at) ORDER BY queued_at, item_id))[1] AS f, max(priority) AS priority, min(depth) AS depth,
              (list(reason ORDER BY queued_at DESC, item_id DESC))[1] AS reason, max(queued_at) AS at_time FROM b WHERE decision = 'admitted' GROUP BY url),
          j AS (SELECT coalesce(o.url, c.url) AS url, o.status IS NOT NULL AND o.status = 'queued' AS waits, c.url IS NULL AS alone, o AS o, c AS c FROM o FULL JOIN c ON c.url = o.url)
          SELECT url, CASE WHEN alone THEN o.depth WHEN waits THEN least(o.depth, c.depth) ELSE c.depth END AS depth, CASE WHEN alone THEN o.priority WHEN waits THEN greatest(o.priority, c.priority) ELSE c.priority END AS priority,
            CASE WHEN alone OR waits THEN o.discovered_from ELSE c.f.discovered_from END AS discovered_from, CASE WHEN alone THEN o.reason ELSE c.reason END AS reason, CASE WHEN alone OR waits THEN o.source_key ELSE c.f.source_key END AS source_key,
            CASE WHEN alone THEN o.status ELSE 'queued' END AS status, CASE WHEN alone OR waits THEN o.queued_at ELSE c.f.queued_at END AS queued_at, CASE WHEN alone THEN o.updated_at ELSE c.at_time END AS updated_at FROM j""",
        "frontier_pop_marked": f"""WITH p AS (SELECT item_id FROM frontier WHERE status = 'queued' ORDER BY priority DESC NULLS LAST, queued_at, item_id LIMIT {POPPED})
          SELECT item_id, CASE WHEN item_id IN (SELECT item_id FROM p) THEN 'active' ELSE status END AS status, CASE WHEN item_id IN (SELECT item_id FROM p) THEN TIMESTAMP '{NOW}' ELSE updated_at END AS updated_at FROM frontier""",
        "frontier_marked": f"""WITH {statuses} SELECT item_id, CASE WHEN f.status <> 'active' OR s.url IS NULL THEN f.status WHEN s.status = 'ok' THEN 'done' WHEN s.status = 'blocked_by_robots' THEN 'blocked' ELSE 'error' END AS status,
          CASE WHEN f.status = 'active' AND s.url IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE updated_at END AS updated_at FROM frontier f LEFT JOIN s ON s.url = f.url""",
        "frontier_waiting": "SELECT item_id, url, priority FROM frontier WHERE status = 'queued'",
        "frontier_reset": "SELECT count(*) AS n_deleted, CAST(0 AS BIGINT) AS n_left FROM frontier",
        "source_visits_set": f"SELECT source_key, CASE WHEN source_key IN (SELECT source_key FROM frontier WHERE status = 'skipped_source_limit' AND source_key IS NOT NULL) THEN CAST({CAP} AS BIGINT) ELSE visits END AS visits FROM source_memory",
        "jobs_on_pages": "SELECT job_id, source_page FROM jobs WHERE source_page IN (SELECT url FROM pages UNION SELECT final_url FROM pages)",
        "query_uses": """WITH u AS (SELECT reason AS query, queued_at FROM frontier WHERE reason IS NOT NULL AND queued_at IS NOT NULL UNION ALL SELECT query, last_used_at FROM queries WHERE last_used_at IS NOT NULL),
          n AS (SELECT query, count(*) AS n, max(queued_at) AS at_time FROM u GROUP BY query)
          SELECT q.query, CAST(coalesce(uses, 0) + coalesce(n, 0) AS BIGINT) AS uses, coalesce(at_time, last_used_at) AS last_used_at FROM queries q LEFT JOIN n ON n.query = q.query""",
    }
