"""Decoding of noisy JSON replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trellium.functions.text import as_text, clamp_int

JOB = "struct<title:string,company:string,location:string,url:string,fit_score:string,reason:string,evidence:string,posting_language:string,language:string,score_source:string,score_basis:string>"
DECISION = f"struct<jobs:array<{JOB}>,follow_urls:array<string>,source_quality:string,source_notes:string>"
_LIMITS = {"title": 300, "company": 200, "location": 200, "url": 1500, "reason": 800, "evidence": 800}


def strip_noise(raw: Column) -> Column:
    """Without reasoning blocks and code fences."""
    t = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?is)<think>.*?</think>", ""))
    t = F.trim(F.regexp_replace(t, r"(?i)^```(?:json)?", ""))
    return F.trim(F.regexp_replace(t, r"```$", ""))


def json_object(raw: Column) -> Column:
    """The JSON object in a reply: the whole of it, else from the first brace to the last; NULL if neither parses."""
    clean = strip_noise(raw)
    inner = F.regexp_extract(clean, r"(?s)\{.*\}", 0)
    is_object = lambda t: F.try_parse_json(t).isNotNull() & t.rlike(r"(?s)^\s*\{")
    return F.when(is_object(clean), clean).when(is_object(inner), inner)


def page_decision(raw: Column) -> Column:
    """struct(jobs, follow_urls, source_quality, source_notes) of a reply; fields cut and clamped, jobs without title or address dropped."""
    d = F.from_json(json_object(raw), DECISION)

    def job(j: Column) -> Column:
        fields = [as_text(j[k], n).alias(k) for k, n in _LIMITS.items()]
        language = as_text(F.coalesce(F.nullif(j["posting_language"], F.lit("")), j["language"]), 80)
        source = F.coalesce(F.nullif(as_text(j["score_source"], 80), F.lit("")), F.lit("llm"))
        return F.struct(*fields, clamp_int(j["fit_score"], 0, 100).alias("fit_score"), language.alias("posting_language"), source.alias("score_source"), as_text(j["score_basis"], 1000).alias("score_basis"))

    jobs = F.filter(F.transform(F.coalesce(d["jobs"], F.array().cast(f"array<{JOB}>")), job), lambda j: (j["title"] != "") & (j["url"] != ""))
    follow = F.array_distinct(F.filter(F.transform(F.coalesce(d["follow_urls"], F.array().cast("array<string>")), lambda s: F.trim(s)), lambda u: u.isNotNull() & (u != "")))
    return F.when(
        d.isNotNull(), F.struct(jobs.alias("jobs"), follow.alias("follow_urls"), clamp_int(d["source_quality"], 0, 100).alias("source_quality"), as_text(d["source_notes"], 1000).alias("source_notes"))
    )


#: Characters kept of a suggested query and of its reason.
QUERY_CHARS, REASON_CHARS = 400, 800


def query_suggestions(raw: Column) -> Column:
    """array<struct<query, reason>> of a reply's queries, which are texts or objects; other items and blank queries are dropped."""
    items = F.try_variant_get(F.try_parse_json(json_object(raw)), "$.queries", "array<variant>")
    text = lambda v, path: F.trim(F.coalesce(F.try_variant_get(v, path, "string"), F.lit("")))

    def read(v: Column) -> Column:
        kind = F.coalesce(F.schema_of_variant(v), F.lit(""))
        alone = kind == "STRING"
        query = F.when(alone, text(v, "$")).when(kind.startswith("OBJECT"), text(v, "$.query")).otherwise("")
        return F.struct(F.substring(query, 1, QUERY_CHARS).alias("query"), F.substring(F.when(alone, "").otherwise(text(v, "$.reason")), 1, REASON_CHARS).alias("reason"))

    return F.filter(F.transform(F.coalesce(items, F.array().cast("array<variant>")), read), lambda q: q["query"] != "")
