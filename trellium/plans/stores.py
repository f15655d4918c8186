"""Stored tables, exports, seeds, event logs and streams: written in the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellium.functions.urls import clean_url, quote_plus
from trellium.plans import memory
from trellium.plans.sqlgen import clean_url_sql, part_sql
from trellium.plans.tables import table
from trellium.session import scratch
from trellium.sources.store import Store, append_events, export_csv, export_jsonl, read_seeds, robots_allow, with_schema
from trellium.streaming.memory import TABLE, follow_events

QUERY_FIELDS = {"query": T.StringType(), "reason": T.StringType(), "uses": T.LongType(), "last_error": T.StringType(), "weight": T.DoubleType()}
QUERY_SCHEMA = T.StructType([T.StructField(k, t) for k, t in QUERY_FIELDS.items()])
HALF = "2024-01-15 00:00:00"
ROBOTS = "User-agent: *\nDisallow: /jobs/\nDisallow: /karriere\nAllow: /\n"


def _export(spark: SparkSession, d: str) -> DataFrame:
    filled = lambda c: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit("-")).alias(c)
    return table(spark, d, "jobs").select("job_id", filled("title"), filled("evidence"), "fit_score")


def csv_export(spark, d):
    """The export read back: quotes, separators and line ends inside values survive."""
    path = scratch(spark, "export-csv")
    export_csv(_export(spark, d), path)
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema("job_id bigint, title string, evidence string, fit_score int").csv(path)


def jsonl_export(spark, d):
    path = scratch(spark, "export-jsonl")
    export_jsonl(_export(spark, d), path)
    return spark.read.schema("job_id bigint, title string, evidence string, fit_score int").json(path)


def schema_defaults(spark, d):
    """An older table under the present schema: missing texts are blank, other missing values NULL."""
    return with_schema(table(spark, d, "queries").select("query", "reason", "uses"), QUERY_SCHEMA)


def seeds_read(spark, d):
    """Start addresses of a seed file of all page addresses with comments, blanks and repeats."""
    path = scratch(spark, "seeds")
    lines = table(spark, d, "pages").select(F.explode(F.array(F.concat(F.lit("  "), "url"), F.lit("# comment"), F.lit(" "), "final_url")).alias("value"))
    lines.write.text(path)
    return read_seeds(spark, path)


def whole_files(spark, d):
    """Documents written as lines of one file and read as a whole text again."""
    path = scratch(spark, "whole")
    table(spark, d, "context_windows").orderBy("window_id").select(F.concat_ws(",", "window_id", "window_name").alias("value")).coalesce(1).write.text(path)
    return spark.read.text(path, wholetext=True).select("value")


def robots_allowed(spark, d):
    return table(spark, d, "pages").select("page_id", robots_allow(F.col("url"), F.when(F.col("page_id") % 3 != 0, F.lit(ROBOTS))).alias("allowed"))


def generation_swap(spark, d):
    """A table after two swaps: the second generation drops what has no score and adds nothing twice."""
    store = Store(spark, scratch(spark, "store"))
    store.swap("jobs", table(spark, d, "jobs").select("job_id", "fit_score"))
    store.swap("jobs", store.read("jobs").filter("fit_score is not null"))
    store.swap("jobs", store.read("jobs").limit(0), 1)  # a generation that is there already is left alone
    return store.read("jobs")


def event_log(spark, d):
    """Two kinds of events appended to one log and read by kind."""
    path = scratch(spark, "events")
    append_events(table(spark, d, "pages").select("page_id", "status", "visited_at"), path, "page", F.col("visited_at"))
    append_events(table(spark, d, "queries").select("query", "uses"), path, "query", F.lit(HALF).cast("timestamp_ntz"))
    log = spark.read.parquet(path).filter("event_type = 'page'")
    return log.select(F.from_json("payload_json", "struct<page_id:bigint,status:string>").alias("p"), "at").select("p.page_id", "p.status", "at")


def streamed_memory(spark, d):
    """Source memory from a stream in two batches; equal to the fold over all events."""
    landing, checkpoint, store = scratch(spark, "landing"), scratch(spark, "stream-checkpoint"), Store(spark, scratch(spark, "stream-store"))
    events = memory.source_events(spark, d).filter("source_key is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    half = F.lit(HALF).cast("timestamp")
    for part in (events.filter(F.col("ts") < half), events.filter(F.col("ts") >= half)):
        part.write.mode("append").parquet(landing)
        follow_events(spark, landing, store, checkpoint, files_per_batch=10_000).awaitTermination()
    return store.read(TABLE)


def redirect_unwrap(spark, d):
    """Page addresses wrapped none to four deep in search engines' redirects, and cleaned."""
    wrapped, url = F.col("url"), F.col("url")
    for level in range(1, 5):
        wrap = (lambda u: F.concat(F.lit("https://duckduckgo.com/l/?uddg="), quote_plus(u))) if level % 2 else (lambda u: F.concat(F.lit("https://www.google.com/url?sa=t&q="), quote_plus(u)))
        wrapped = F.when(F.col("page_id") % 5 >= level, wrap(wrapped)).otherwise(wrapped)
    return table(spark, d, "pages").select("page_id", wrapped.alias("wrapped"), url.alias("url")).select("page_id", clean_url("wrapped").alias("cleaned"))


def queries():
    return {
        "csv_export": csv_export, "jsonl_export": jsonl_export, "schema_defaults": schema_defaults, "seeds_read": seeds_read, "whole_files": whole_files, "robots_allowed": robots_allowed, "generation_swap": generation_swap,
        "event_log": event_log, "streamed_memory": streamed_memory, "redirect_unwrap": redirect_unwrap,
    }


def sql() -> dict[str, str]:
    export = "SELECT job_id, coalesce(nullif(trim(title), ''), '-') AS title, coalesce(nullif(trim(evidence), ''), '-') AS evidence, fit_score FROM jobs"
    path = part_sql("url", 3)
    return {
        "csv_export": export,
        "jsonl_export": export,
        "schema_defaults": "SELECT query, coalesce(reason, '') AS reason, uses, '' AS last_error, CAST(NULL AS DOUBLE) AS weight FROM queries",
        "seeds_read": f"SELECT DISTINCT u AS url FROM (SELECT {clean_url_sql('url')} AS u FROM (SELECT url FROM pages UNION ALL SELECT final_url FROM pages)) WHERE u IS NOT NULL",
        "whole_files": "SELECT string_agg(window_id || ',' || window_name, chr(10) ORDER BY window_id) || chr(10) AS value FROM context_windows",
        "robots_allowed": f"SELECT page_id, page_id % 3 = 0 OR NOT (starts_with({path}, '/jobs/') OR starts_with({path}, '/karriere')) AS allowed FROM pages",
        "generation_swap": "SELECT job_id, fit_score FROM jobs WHERE fit_score IS NOT NULL",
        "event_log": "SELECT page_id, status, visited_at AS at FROM pages",
        "streamed_memory": memory.sql()["source_memory_fold"],
        "redirect_unwrap": f"SELECT page_id, {clean_url_sql('url')} AS cleaned FROM pages",
    }
