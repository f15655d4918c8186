"""Source memory: fold, decay, reports, streaks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellium.operators.keyed import ranked
from trellium.operators.memory import decayed, source_memory_fold, with_streak
from trellium.plans.keyed import jobs_latest
from trellium.plans.tables import table

#: Entries of each section of the memory text, and what stands where there are none.
IN_PROMPT = 8
NO_MEMORY = "No source memory yet. Explore conservatively and prefer public career/job pages."
NO_SOURCES = "no visited sources yet"


def source_events(spark: SparkSession, d: str) -> DataFrame:
    """Events of the driver as outcomes of page visits."""
    e = table(spark, d, "events")
    bought = F.col("event_type") == "purchase"
    status = F.when(F.col("event_type") == "error", "error:x").when(F.col("event_type") == "view", "blocked_by_robots").otherwise("ok")
    return e.select(
        F.concat(F.lit("u"), F.col("user_id")).alias("source_key"),
        "ts",
        F.col("event_id").alias("id"),
        status.alias("status"),
        F.when(bought, F.lit(1) + F.col("event_id") % 3).otherwise(0).cast("bigint").alias("jobs"),
        F.when(bought & (F.col("value") > 100), 1).otherwise(0).cast("bigint").alias("high_fit"),
        (F.floor("value").cast("bigint") % 101).alias("quality"),
    )


def fold(spark: SparkSession, d: str) -> DataFrame:
    return source_memory_fold(source_events(spark, d))


def memory_decay(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_memory").select("source_key", decayed(F.col("score")).alias("score"))




def top_sources(spark: SparkSession, d: str) -> DataFrame:
    return ranked(fold(spark, d).filter("visits > 0"), [F.desc("score"), F.desc("high_fit_jobs"), F.desc("jobs_found"), F.desc("visits"), F.asc("source_key")], 25)


def weak_sources(spark: SparkSession, d: str) -> DataFrame:
    return ranked(fold(spark, d).filter("visits > 0"), [F.asc("score"), F.desc("no_job_streak"), F.desc("errors"), F.asc("source_key")], 25)


def page_streaks(spark: SparkSession, d: str) -> DataFrame:
    """Pages without jobs in a row, per source and in order of visits."""
    pages = table(spark, d, "pages").filter("source_key is not null").select("page_id", "source_key", "visited_at", "jobs_found")
    return with_streak(pages, "source_key", ["visited_at", "page_id"], F.coalesce(F.col("jobs_found"), F.lit(0)) > 0).select("page_id", "source_key", "streak")


def memory_summary(spark: SparkSession, d: str) -> DataFrame:
    """Best sources of the stored memory as one line of text."""
    best = ranked(table(spark, d, "source_memory").filter("visits > 0"), [F.desc("score"), F.desc("high_fit_jobs"), F.asc("source_key")], 8)
    lines = best.select(F.struct(-F.col("score"), -F.col("high_fit_jobs"), F.col("source_key").alias("k"), F.concat(F.col("source_key"), F.lit(": jobs="), F.col("jobs_found"), F.lit(", high="), F.col("high_fit_jobs")).alias("t")).alias("x"))
    return lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "; ").alias("summary"))


@F.pandas_udf(T.StringType())
def _one_place(x: pd.Series) -> pd.Series:
    """As Python rounds: by the exact value of the double, ties to even."""
    return x.map(lambda v: f"{v:.1f}")


def _lines(rows: DataFrame, keys: list[Column], **texts: Column) -> DataFrame:
    """One row: for each text the list of its lines, of the first rows by ``keys``, all ascending."""
    best = ranked(rows, [k.asc_nulls_last() for k in keys], IN_PROMPT)
    order = [F.struct(k.isNull(), k).alias(f"k{n}") for n, k in enumerate(keys)]
    found = best.select(F.struct(*order, *[t.alias(c) for c, t in texts.items()]).alias("x")).agg(F.array_sort(F.collect_list("x")).alias("a"))
    return found.select(*[F.col(f"a.{c}").alias(c) for c in texts])


def memory_summary_full(spark: SparkSession, d: str) -> DataFrame:
    """The stored memory as prompt text: good sources, weak sources and recent jobs; and the good ones as one line."""
    m = table(spark, d, "source_memory").filter("visits > 0").withColumn("score", F.coalesce("score", F.lit(50.0))).fillna(0, ["jobs_found", "high_fit_jobs", "no_job_streak", "errors"])
    score, notes = _one_place("score"), F.coalesce("notes", F.lit(""))
    good = _lines(
        m,
        [-F.col("score"), -F.col("high_fit_jobs"), -F.col("jobs_found"), -F.col("visits"), F.col("source_key")],
        good=F.concat(F.lit("- "), F.col("source_key"), F.lit(": score="), score, F.lit(", jobs="), F.col("jobs_found"), F.lit(", high_fit="), F.col("high_fit_jobs"), F.lit(", notes="), notes),
        line=F.concat(F.col("source_key"), F.lit(":score="), score, F.lit(",visits="), F.col("visits"), F.lit(",jobs="), F.col("jobs_found"), F.lit(",high_fit="), F.col("high_fit_jobs")),
    )
    weak = _lines(
        m,
        [F.col("score"), -F.col("no_job_streak"), -F.col("errors"), F.col("source_key")],
        weak=F.concat(F.lit("- "), F.col("source_key"), F.lit(": score="), score, F.lit(", no_job_streak="), F.col("no_job_streak"), F.lit(", errors="), F.col("errors"), F.lit(", notes="), notes),
    )
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    known = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown"))
    recent = _lines(
        jobs_latest(spark, d),
        [-F.unix_micros(F.col("last_seen_at").cast("timestamp")), F.col("job_id")],
        recent=F.concat(F.lit("- "), text("fit_score"), F.lit(" "), text("title"), F.lit(" at "), text("company"), F.lit(" ("), text("location"), F.lit("; score_source="), known("score_source"), F.lit("; language="), known("posting_language"), F.lit(") from "), text("source_key")),
    )
    part = lambda head, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{head}\n"), F.array_join(c, "\n")))
    whole = F.concat_ws("\n", part("Good sources:", "good"), part("Weak sources:", "weak"), part("Recent matched jobs:", "recent"))
    return good.crossJoin(weak).crossJoin(recent).select(
        F.coalesce(F.nullif(whole, F.lit("")), F.lit(NO_MEMORY)).alias("summary"), F.when(F.size("line") > 0, F.array_join("line", "; ")).otherwise(NO_SOURCES).alias("line")
    )


def queries():
    return {
        "source_memory_fold": fold, "source_memory_decay": memory_decay, "top_sources": top_sources, "weak_sources": weak_sources, "no_job_streak_windows": page_streaks, "memory_summary_text": memory_summary,
        "memory_summary_full": memory_summary_full,
    }


_FOLD = """
WITH v AS (
  SELECT 'u' || user_id AS source_key, ts, event_id AS id, CASE event_type WHEN 'error' THEN 'error:x' WHEN 'view' THEN 'blocked_by_robots' ELSE 'ok' END AS status,
    CASE WHEN event_type = 'purchase' THEN 1 + event_id % 3 ELSE 0 END AS jobs, CASE WHEN event_type = 'purchase' AND value > 100 THEN 1 ELSE 0 END AS high_fit,
    CAST(floor(value) AS BIGINT) % 101 AS quality FROM events WHERE user_id IS NOT NULL),
l AS (
  SELECT source_key, list({'status': status, 'jobs': CAST(jobs AS BIGINT), 'high': CAST(high_fit AS BIGINT), 'q': quality, 'score': CAST(0 AS BIGINT), 'streak': CAST(0 AS BIGINT)} ORDER BY ts, id) AS steps,
    count(*) AS visits, CAST(sum(jobs) AS BIGINT) AS jobs_found, CAST(sum(high_fit) AS BIGINT) AS high_fit_jobs,
    count(*) FILTER (WHERE status LIKE 'error%') AS errors, count(*) FILTER (WHERE status = 'blocked_by_robots') AS blocked FROM v GROUP BY 1),
f AS (
  SELECT *, list_reduce(steps, lambda a, x: {'status': x.status, 'jobs': x.jobs, 'high': x.high, 'q': x.q,
      'score': greatest(0, least(10000, a.score + CASE
        WHEN x.status = 'ok' THEN 600 * x.jobs + 800 * x.high + 4 * greatest(0, least(100, x.q)) + CASE WHEN x.jobs > 0 THEN 0 ELSE -150 + CASE WHEN a.streak + 1 >= 4 THEN -150 ELSE 0 END END + CASE WHEN x.q <= 30 THEN -250 ELSE 0 END
        WHEN x.status = 'blocked_by_robots' THEN -300 ELSE -500 END)),
      'streak': CASE WHEN x.status = 'ok' AND x.jobs > 0 THEN 0 ELSE a.streak + 1 END},
    {'status': '', 'jobs': CAST(0 AS BIGINT), 'high': CAST(0 AS BIGINT), 'q': CAST(0 AS BIGINT), 'score': CAST(5000 AS BIGINT), 'streak': CAST(0 AS BIGINT)}) AS r FROM l),
folded AS (SELECT source_key, r.score / 100.0 AS score, visits, jobs_found, high_fit_jobs, errors, blocked, r.streak AS no_job_streak, greatest(0, least(100, r.q)) AS last_quality FROM f)
"""


def sql() -> dict[str, str]:
    cast = "SELECT source_key, CAST(score AS DOUBLE) AS score, visits, jobs_found, high_fit_jobs, errors, blocked, no_job_streak, last_quality FROM folded"
    return {
        "source_memory_fold": f"{_FOLD} {cast}",
        "source_memory_decay": "SELECT source_key, CAST(50 AS DOUBLE) + (coalesce(score, 50) - CAST(50 AS DOUBLE)) * CAST(0.98 AS DOUBLE) AS score FROM source_memory",
        "top_sources": f"{_FOLD} {cast} WHERE visits > 0 ORDER BY score DESC, high_fit_jobs DESC, jobs_found DESC, visits DESC, source_key LIMIT 25",
        "weak_sources": f"{_FOLD} {cast} WHERE visits > 0 ORDER BY score, no_job_streak DESC, errors DESC, source_key LIMIT 25",
        "no_job_streak_windows": """
          WITH p AS (SELECT page_id, source_key, visited_at, sum(CASE WHEN jobs_found > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source_key ORDER BY visited_at, page_id) AS island FROM pages WHERE source_key IS NOT NULL)
          SELECT page_id, source_key, row_number() OVER (PARTITION BY source_key, island ORDER BY visited_at, page_id) - CASE WHEN island > 0 THEN 1 ELSE 0 END AS streak FROM p""",
        "memory_summary_text": """
          SELECT coalesce(string_agg(source_key || ': jobs=' || jobs_found || ', high=' || high_fit_jobs, '; ' ORDER BY score DESC, high_fit_jobs DESC, source_key), '') AS summary FROM
          (SELECT * FROM source_memory WHERE visits > 0 ORDER BY score DESC, high_fit_jobs DESC, source_key LIMIT 8)""",
        "memory_summary_full": f"""
          WITH m AS (SELECT source_key, coalesce(score, 50) AS score, visits, coalesce(jobs_found, 0) AS jobs, coalesce(high_fit_jobs, 0) AS high, coalesce(no_job_streak, 0) AS streak, coalesce(errors, 0) AS errors, coalesce(notes, '') AS notes FROM source_memory WHERE visits > 0),
          g AS (SELECT *, row_number() OVER (ORDER BY score DESC, high DESC, jobs DESC, visits DESC, source_key) AS n FROM m),
          w AS (SELECT *, row_number() OVER (ORDER BY score, streak DESC, errors DESC, source_key) AS n FROM m),
          j AS (SELECT *, row_number() OVER (ORDER BY last_seen_at DESC NULLS LAST, job_id) AS n FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY last_seen_at DESC NULLS LAST, job_id DESC) AS r FROM jobs WHERE url IS NOT NULL) WHERE r = 1),
          t AS (SELECT
            (SELECT 'Good sources:' || chr(10) || string_agg(format('- {{}}: score={{:.1f}}, jobs={{}}, high_fit={{}}, notes={{}}', source_key, score, jobs, high, notes), chr(10) ORDER BY n) FROM g WHERE n <= {IN_PROMPT}) AS good,
            (SELECT string_agg(format('{{}}:score={{:.1f}},visits={{}},jobs={{}},high_fit={{}}', source_key, score, visits, jobs, high), '; ' ORDER BY n) FROM g WHERE n <= {IN_PROMPT}) AS line,
            (SELECT 'Weak sources:' || chr(10) || string_agg(format('- {{}}: score={{:.1f}}, no_job_streak={{}}, errors={{}}, notes={{}}', source_key, score, streak, errors, notes), chr(10) ORDER BY n) FROM w WHERE n <= {IN_PROMPT}) AS weak,
            (SELECT 'Recent matched jobs:' || chr(10) || string_agg('- ' || coalesce(CAST(fit_score AS VARCHAR), '') || ' ' || coalesce(title, '') || ' at ' || coalesce(company, '') || ' (' || coalesce(location, '') || '; score_source=' || coalesce(nullif(score_source, ''), 'unknown')
              || '; language=' || coalesce(nullif(posting_language, ''), 'unknown') || ') from ' || coalesce(source_key, ''), chr(10) ORDER BY n) FROM j WHERE n <= {IN_PROMPT}) AS recent)
          SELECT coalesce(nullif(concat_ws(chr(10), good, weak, recent), ''), '{NO_MEMORY}') AS summary, coalesce(line, '{NO_SOURCES}') AS line FROM t""",
    }
