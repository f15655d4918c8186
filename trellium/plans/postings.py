"""Postings embedded in pages, made of the stored postings in the shapes that sites use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellium.functions.html import json_ld
from trellium.functions.jsonld import LIMITS, embedded_leaves, json_ld_postings, postings_text, with_embedded
from trellium.operators.keyed import computed
from trellium.plans.tables import table


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """A page for each saved posting: by the number of the row its data are an object, a graph, a list or deep
    within other things; beside them stand a text that does not parse and the same posting again."""
    q = lambda c: F.when(F.col(c).isNull(), "null").otherwise(F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1))
    j = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    title, company, location, evidence = (q(c) for c in ("title", "company", "location", "evidence"))
    number = F.col("job_id").cast("string")
    plain = j('{"@type":"JobPosting","title":', title, ',"hiringOrganization":{"@type":"Organization","name":', company, '},"jobLocation":{"@type":"Place","address":{"addressLocality":', location, ',"addressCountry":"DE"}},"url":"/jobs/', number, '","employmentType":["FULL_TIME"," ","OTHER"],"datePosted":20250301}')
    listed = j('{"type":["Thing","jobposting"],"title":', title, ',"hiringOrganization":', company, ',"jobLocation":[{"address":', location, '},{"address":', location, '},"Remote"],"sameAs":"https://b.test/', number, '","description":', evidence, "}")
    deep = j('{"mainEntity":{"itemListElement":[{"item":{"@type":"JobPosting","title":[', title, ',"II"],"hiringOrganization":{"legalName":', company, '},"jobLocation":{"addressRegion":', location, "}}}]}}")
    shape = F.col("job_id") % 4
    body = F.when(shape == 0, plain).when(shape == 1, j('{"@graph":[{"@type":"WebPage"},', plain, "]}")).when(shape == 2, j("[", listed, "]")).otherwise(deep)
    script = lambda s: j('<script type="application/ld+json">', s, "</script>")
    safe = F.replace(body, F.lit("</"), F.lit("<\\/"))
    html = F.concat(F.lit("<html>"), script(F.lit("{broken")), script(safe), script(safe), F.lit("</html>"))
    return table(spark, d, "jobs").select("job_id", html.alias("html"), F.lit("https://a.test/x/y").alias("page"), "evidence")


def _postings(spark: SparkSession, d: str) -> DataFrame:
    shredded = computed(_pages(spark, d), "leaves", embedded_leaves(json_ld(F.col("html"))))
    return computed(shredded, "postings", json_ld_postings(F.col("leaves"), F.col("page")))


def embedded_postings(spark: SparkSession, d: str) -> DataFrame:
    return _postings(spark, d).select("job_id", F.explode("postings").alias("p")).select("job_id", *[F.col(f"p.{f}").alias(f) for f in LIMITS])


def embedded_postings_text(spark: SparkSession, d: str) -> DataFrame:
    return _postings(spark, d).select("job_id", postings_text(F.col("postings")).alias("as_text"))


def page_text_augmented(spark: SparkSession, d: str) -> DataFrame:
    """The visible text of a page with its embedded postings behind it."""
    return _postings(spark, d).select("job_id", with_embedded(F.trim(F.coalesce("evidence", F.lit(""))), F.col("postings")).alias("page_text"))


def queries():
    return {"embedded_postings": embedded_postings, "embedded_postings_text": embedded_postings_text, "page_text_augmented": page_text_augmented}


def sql() -> dict[str, str]:
    blank = "[ \\s\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{001C}-\\x{001F}]+"
    text = lambda c: f"regexp_replace(coalesce({c}, ''), '^{blank}|{blank}$', '', 'g')"
    found = f"""p AS (SELECT job_id, job_id % 4 AS shape, {text("title")} AS t, {text("company")} AS c, {text("location")} AS l, {text("evidence")} AS e FROM jobs),
      f AS (SELECT job_id, substring(CASE WHEN shape = 3 THEN concat_ws(', ', nullif(t, ''), 'II') ELSE t END, 1, 300) AS title,
        substring(CASE WHEN c <> '' THEN c WHEN shape < 2 THEN 'Organization' ELSE '' END, 1, 200) AS company,
        substring(CASE WHEN shape < 2 THEN concat_ws(', ', nullif(l, ''), 'DE') WHEN shape = 3 THEN l ELSE concat_ws('; ', nullif(l, ''), CASE WHEN l <> 'Remote' THEN 'Remote' END) END, 1, 200) AS location,
        CASE WHEN shape < 2 THEN 'https://a.test/jobs/' || job_id WHEN shape = 2 THEN 'https://b.test/' || job_id ELSE 'https://a.test/x/y' END AS url,
        CASE WHEN shape = 2 THEN substring(e, 1, 4000) ELSE '' END AS description, CASE WHEN shape < 2 THEN 'FULL_TIME, OTHER' ELSE '' END AS employment_type,
        CASE WHEN shape < 2 THEN '20250301' ELSE '' END AS date_posted, '' AS valid_through FROM p WHERE t <> '' OR shape = 3)"""
    shown = """'STRUCTURED JOBPOSTING DATA:' || chr(10) || concat_ws(chr(10), '1. Title: ' || title, CASE WHEN company <> '' THEN '   Company: ' || company END, CASE WHEN location <> '' THEN '   Location: ' || location END,
      CASE WHEN employment_type <> '' THEN '   Employment type: ' || employment_type END, '   URL: ' || url)"""
    return {
        "embedded_postings": f"WITH {found} SELECT * FROM f",
        "embedded_postings_text": f"WITH {found} SELECT j.k AS job_id, coalesce({shown}, '') AS as_text FROM (SELECT job_id AS k FROM jobs) j LEFT JOIN f ON f.job_id = j.k",
        "page_text_augmented": f"WITH {found} SELECT j.k AS job_id, concat_ws(chr(10) || chr(10), nullif(trim(coalesce(j.visible, '')), ''), {shown}) AS page_text FROM (SELECT job_id AS k, evidence AS visible FROM jobs) j LEFT JOIN f ON f.job_id = j.k",
    }
