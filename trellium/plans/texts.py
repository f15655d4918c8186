"""Text, term, place and JSON operators over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trellium.functions import text as T
from trellium.functions.decode import json_object, page_decision
from trellium.functions.geo import haversine_km, named_places
from trellium.functions.urls import career_urls, root_url, url_path
from trellium.plans.sqlgen import part_sql
from trellium.plans.tables import table
from trellium.session import spread

TERMS = ["Erfahrung", "Teilzeit", "supplier", "Verträge", "Maschinen", "team", "expérience", "Wochen", "contract", "zkušenost"]
WORDS = ["jobs", "Engineer", "Einkäufer", "Schichtführer", "in", "controller"]
COMPANIES = ["Dütapenen Möbelwerke", "Logistik Stähozofer", "Hafenlicht", "Brofimoral & Co"]
PHRASES = ["Data Engineer", "Cost Controller", "Schichtführer", "HR Partner"]
REGIONS = ["München", "Wacholder", "Birken", "remote", "Quarz", "Deutschland"]
#: Centre and radius of the place reports.
CENTRE, RADIUS_KM = (48.137154, 11.576124), 250.0


def term_hits_substring(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", T.substring_hits("text", TERMS).alias("h")).select("doc_id", F.array_join("h", ",").alias("hits"), F.size("h").cast("bigint").alias("n_hits"))


def term_hits_token(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(T.token_hits("title", WORDS), ",").alias("hits"))


def page_text_compact(spark, d):
    """Documents compacted with the limits of the operator: 180 lines, 240 relevant ones, 14,000 characters."""
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", T.compacted("text", ["contract", "vertrag", "salario", "lidí"]).alias("compact"))


def text_clip(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clip("text", 120).alias("clipped"), T.truncate("text", 60).alias("short"), T.token_estimate("text").alias("n_tokens"))


def as_text_fields(spark, d):
    return table(spark, d, "jobs").select("job_id", T.as_text("evidence", 40).alias("evidence"), T.clamp_int("fit_score", 20, 80).alias("fit"))


def company_words(spark, d):
    return table(spark, d, "jobs").select("company").distinct().select("company", T.company_words("company").alias("words"), F.replace(T.company_words("company"), F.lit(" "), F.lit("")).alias("joined"))


def company_mentions(spark, d):
    return table(spark, d, "jobs").select("job_id", T.mentions_company(F.concat_ws("\n", "company", "title"), COMPANIES).alias("mentioned"))


def unique_terms(spark, d):
    """Distinct words of each search query, first spelling kept."""
    return table(spark, d, "queries").select("query", F.array_join(T.unique_items(F.split("query", " ")), "|").alias("terms"))


def haversine(spark, d):
    g = table(spark, d, "gazetteer").select("place_id", F.round(haversine_km(F.col("lat"), F.col("lon"), *CENTRE), 6).alias("km"))
    return g.withColumn("inside", F.col("km") <= RADIUS_KM)


def nearest_city(spark, d):
    """Places named in each distinct location: the nearest to the centre, and how many lie inside the radius."""
    met = named_places(table(spark, d, "jobs").select("location"), "location", table(spark, d, "gazetteer"), *CENTRE)
    near = met.groupBy("location").agg(F.min(F.struct("distance_km", "place")).alias("n"), F.count("*").alias("n_places"), F.count_if(F.col("distance_km") <= RADIUS_KM).alias("n_inside"))
    return near.select("location", "n.place", F.round("n.distance_km", 6).alias("km"), "n_places", "n_inside")


def _replies(spark, d) -> DataFrame:
    """Replies wrapped in noise, made of the events' own JSON."""
    body = F.concat(F.lit('{"jobs":[{"title":" T'), F.col("event_id"), F.lit('","url":"u/'), F.col("user_id"), F.lit('","fit_score":'), F.col("event_id") % 150, F.lit('},{"title":"","url":"x"}],"follow_urls":["a","a"," b "],"source_quality":"'), F.col("event_id") % 130, F.lit('"}'))
    wrapped = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("<think>{no}</think>\n```json\n"), body, F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Here: "), body, F.lit(" done"))).otherwise(F.lit("no object at all"))
    return table(spark, d, "events").select("event_id", wrapped.alias("raw"))


def json_decode_noise(spark, d):
    return _replies(spark, d).select("event_id", json_object(F.col("raw")).isNotNull().alias("parsed"))


def page_decision_decode(spark, d):
    x = _replies(spark, d).select("event_id", page_decision(F.col("raw")).alias("p")).filter("p is not null")
    job = F.col("p.jobs")[0]
    return x.select("event_id", F.size("p.jobs").cast("bigint").alias("n_jobs"), job["title"].alias("title"), job["fit_score"].alias("fit"), job["score_source"].alias("score_source"), F.array_join("p.follow_urls", ",").alias("follow"), F.col("p.source_quality").alias("quality"))


def event_props(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "struct<k:bigint>")["k"].alias("k"))


def section_fill_down(spark, d):
    """Heading above each line of a document, filled down."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    line = F.trim(F.regexp_replace("line", "\r", ""))
    heading = F.when(line.rlike(r"^[^.!?|•]{3,40}$"), line)
    w = Window.partitionBy("doc_id").orderBy("line_no")
    return lines.withColumn("section", F.last(heading, ignorenulls=True).over(w)).groupBy("doc_id", "section").agg(F.count("*").alias("n_lines"))


def prompt_budget(spark, d):
    """First limit of a shrinking sequence with which a document fits its prompt."""
    limits = [int(14_000 * 0.65**i) for i in range(19)]
    fits = F.filter(F.array(*[F.lit(x) for x in limits]), lambda x: F.ceil(F.least(F.length("text"), x) / 4.0) <= 800)
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.try_element_at(fits, F.lit(1)), F.lit(0)).alias("char_limit"))


def title_from_link(spark, d):
    return table(spark, d, "pages").select("page_id", T.title_from_link(F.lit(None).cast("string"), url_path("url")).alias("made"), T.title_from_link(F.col("title"), url_path("url")).alias("shown"))


def title_parts(spark, d):
    return table(spark, d, "jobs").select("job_id", F.array_join(T.split_terms("title"), "|").alias("parts"))


def term_regex_hits(spark, d):
    return table(spark, d, "jobs").select("job_id", F.coalesce(F.col("title").rlike(T.term_regex(PHRASES)), F.lit(False)).alias("hit"))


def first_location_term(spark, d):
    """First region named in a posting's own texts, each cut as a prompt would cut it."""
    text = F.concat_ws("\n", "location", "title", "company", F.substring("evidence", 1, 3000))
    return table(spark, d, "jobs").select("job_id", T.first_term(text, REGIONS).alias("term"))


def links_json(spark, d):
    """Posting links as prompt text, fields cut and scores to two places."""
    j = table(spark, d, "jobs").filter("fit_score is not null")
    return j.select("job_id", F.to_json(F.struct(T.truncate(F.coalesce("title", F.lit("")), 20).alias("text"), "url", F.round(F.col("fit_score") / 7.0, 2).alias("score"))).alias("link"))


def career_expansion(spark, d):
    """Career addresses of the three first seen domains of every source."""
    j = table(spark, d, "jobs").filter("source_key is not null").select("source_key", root_url("url").alias("root"), "first_seen_at", "job_id")
    first = j.groupBy("source_key", "root").agg(F.min(F.struct("first_seen_at", "job_id")).alias("at"))
    rank = F.row_number().over(Window.partitionBy("source_key").orderBy("at"))
    few = first.withColumn("n", rank).filter("n <= 3")
    return few.select("source_key", F.explode(career_urls("root")).alias("candidate")).groupBy("source_key").agg(F.count_distinct("candidate").alias("n_candidates"))


def queries():
    return {
        "term_hits_substring": term_hits_substring, "term_hits_token": term_hits_token, "page_text_compact": page_text_compact, "page_text_compact_full": page_text_compact, "text_clip": text_clip, "as_text_fields": as_text_fields, "company_words": company_words, "company_mentions": company_mentions,
        "ordered_unique_terms": unique_terms, "haversine": haversine, "nearest_city": nearest_city, "json_decode_noise": json_decode_noise, "page_decision_decode": page_decision_decode, "event_props": event_props, "section_fill_down": section_fill_down, "prompt_budget_limits": prompt_budget,
        "title_from_link": title_from_link, "title_parts": title_parts, "term_regex_hits": term_regex_hits, "first_location_term": first_location_term, "links_json": links_json, "career_expansion": career_expansion,
    }


def _folded_sql(x: str) -> str:
    return f"replace(lower(coalesce({x}, '')), 'ß', 'ss')"


def sql() -> dict[str, str]:
    struct = lambda terms: "[" + ", ".join(f"{{'t': '{t}', 'k': '{T.fold_term(t)}'}}" for t in T.unique_terms(terms)) + "]"
    sub = f"list_filter({struct(TERMS)}, lambda t: contains({_folded_sql('text')}, t.k))"
    fold = _folded_sql("url_decode(title)")
    trans = f"replace(replace(replace({fold}, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue')"
    tokens = "[" + ", ".join(f"CASE WHEN regexp_matches({fold} || chr(10) || {trans}, '{T.token_pattern(t)}') THEN '{t}' END" for t in WORDS) + "]"
    lines = "list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '[ \\t]+', ' ', 'g'), '\\r\\n|\\n|\\r'), lambda s: trim(s)), lambda s: s <> '')"
    relevant = "list_filter(l, lambda s: regexp_matches(lower(s), 'contract|vertrag|salario|lidí'))[1:240]"
    words = "trim(regexp_replace(replace(replace(translate(lower(coalesce(company, '')), '{a}', '{p}'), 'ß', 'ss'), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))".format(a=T._ACCENTED, p=T._PLAIN)
    plain = lambda n: " ".join("".join(c if c.isalnum() and c.isascii() else " " for c in T._fold_name(n)).split())
    both = words.replace("coalesce(company, '')", "concat_ws(chr(10), company, title)")
    mentions = " ".join(f"WHEN contains(' ' || {both} || ' ', ' {plain(n)} ') OR contains(replace({both}, ' ', ''), '{plain(n).replace(' ', '')}') THEN '{n}'" for n in COMPANIES)
    tidy = "list_transform(string_split(query, ' '), lambda t: regexp_replace(regexp_replace(t, '\\s+', ' ', 'g'), '^[\\s\\-–—:;,.•]+|[\\s\\-–—:;,.•]+$', '', 'g'))"
    km = f"2 * 6371.0088 * atan2(sqrt(a), sqrt(1 - a))"
    a = f"pow(sin(radians({CENTRE[0]} - lat) / 2), 2) + cos(radians(lat)) * cos(radians({CENTRE[0]})) * pow(sin(radians({CENTRE[1]} - lon) / 2), 2)"
    hay = lambda x: f"(' ' || regexp_replace({_folded_sql(x)} || ' | ' || replace(replace(replace({_folded_sql(x)}, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g') || ' ')"
    pw = f"(' ' || trim(regexp_replace({_folded_sql('place')}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) || ' ')"
    pu = f"replace(replace(replace({pw}, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue')"
    tail = f"list_last(string_split(trim(url_decode({part_sql('url', 3)}), '/'), '/'))"
    made = f"left(array_to_string(list_transform(string_split(trim(regexp_replace({tail}, '[-_]+', ' ', 'g')), ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' '), 300)"
    shown = "trim(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g'))"
    return {
        "term_hits_substring": f"SELECT doc_id, array_to_string(list_transform(h, lambda t: t.t), ',') AS hits, len(h) AS n_hits FROM (SELECT doc_id, {sub} AS h FROM documents)",
        "term_hits_token": f"SELECT page_id, array_to_string(list_filter({tokens}, lambda t: t IS NOT NULL), ',') AS hits FROM pages",
        "page_text_compact": f"""SELECT doc_id, left(array_to_string(l[1:180], chr(10)) || CASE WHEN len({relevant}) > 0 THEN chr(10) || chr(10) || 'LIKELY RELEVANT LINES:' || chr(10) || array_to_string({relevant}, chr(10)) ELSE '' END, 14000) AS compact
            FROM (SELECT doc_id, {lines} AS l FROM documents)""",
        "page_text_compact_full": f"""SELECT doc_id, left(array_to_string(l[1:180], chr(10)) || CASE WHEN len({relevant}) > 0 THEN chr(10) || chr(10) || 'LIKELY RELEVANT LINES:' || chr(10) || array_to_string({relevant}, chr(10)) ELSE '' END, 14000) AS compact
            FROM (SELECT doc_id, {lines} AS l FROM documents)""",
        "text_clip": "SELECT doc_id, CASE WHEN length(text) > 120 THEN left(text, 108) || chr(10) || '[truncated]' ELSE text END AS clipped, CASE WHEN length(text) > 60 THEN rtrim(left(text, 59)) || '…' ELSE text END AS short, CAST(ceil(length(text) / 4.0) AS BIGINT) AS n_tokens FROM documents",
        "as_text_fields": "SELECT job_id, left(trim(coalesce(evidence, '')), 40) AS evidence, least(greatest(coalesce(fit_score, 20), 20), 80) AS fit FROM jobs",
        "company_words": f"SELECT company, {words} AS words, replace({words}, ' ', '') AS joined FROM (SELECT DISTINCT company FROM jobs)",
        "company_mentions": f"SELECT job_id, CASE {mentions} END AS mentioned FROM jobs",
        "ordered_unique_terms": f"SELECT query, array_to_string(list_filter(a, lambda t, i: t <> '' AND list_position(list_transform(a, lambda u: lower(u)), lower(t)) = i), '|') AS terms FROM (SELECT query, {tidy} AS a FROM queries)",
        "haversine": f"SELECT place_id, round({km}, 6) AS km, {km} <= {RADIUS_KM} AS inside FROM (SELECT *, {a} AS a FROM gazetteer)",
        "nearest_city": f"""WITH g AS (SELECT place, {pw} AS w, {pu} AS u, round({km}, 6) AS km FROM (SELECT *, {a} AS a FROM gazetteer)), l AS (SELECT location, {hay('location')} AS h FROM (SELECT DISTINCT location FROM jobs WHERE location IS NOT NULL))
            SELECT location, arg_min(place, {{'k': km, 'p': place}}) AS place, min(km) AS km, count(*) AS n_places, count(*) FILTER (WHERE km <= {RADIUS_KM}) AS n_inside FROM l JOIN g ON contains(l.h, g.w) OR contains(l.h, g.u) GROUP BY location""",
        "json_decode_noise": "SELECT event_id, event_id % 3 <> 2 AS parsed FROM events",
        "page_decision_decode": "SELECT event_id, CAST(1 AS BIGINT) AS n_jobs, 'T' || event_id AS title, CAST(least(event_id % 150, 100) AS INTEGER) AS fit, 'llm' AS score_source, 'a,b' AS follow, CAST(least(event_id % 130, 100) AS INTEGER) AS quality FROM events WHERE event_id % 3 <> 2",
        "event_props": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
        "section_fill_down": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
            s AS (SELECT doc_id, last_value(CASE WHEN regexp_matches(trim(replace(line, chr(13), '')), '^[^.!?|•]{3,40}$') THEN trim(replace(line, chr(13), '')) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n) AS section FROM l)
            SELECT doc_id, section, count(*) AS n_lines FROM s GROUP BY doc_id, section""",
        "title_from_link": f"SELECT page_id, {made} AS made, left(CASE WHEN {shown} <> '' THEN {shown} ELSE {made} END, 300) AS shown FROM pages",
        "title_parts": "SELECT job_id, array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_replace(title, '\\([^)]*\\)', ' ', 'g'), '\\s+[/|]\\s+|\\s*[;,]\\s+'), lambda t: trim(regexp_replace(trim(t), '(?i)^(and|or|oder|und)\\s+', ''))), lambda t: length(t) >= 2), '|') AS parts FROM jobs",
        "term_regex_hits": f"SELECT job_id, coalesce(regexp_matches(title, '{T.term_regex(PHRASES).replace('(?iU)', '(?i)')}'), false) AS hit FROM jobs",
        "first_location_term": f"SELECT job_id, coalesce(list_filter([{', '.join(f"{{'t': '{t}', 'k': '{T.fold_term(t)}'}}" for t in REGIONS)}], lambda t: contains({_folded_sql("concat_ws(chr(10), location, title, company, left(evidence, 3000))")}, t.k))[1].t, '') AS term FROM jobs",
        "links_json": """SELECT job_id, CAST(json_object('text', CASE WHEN length(coalesce(title, '')) > 20 THEN rtrim(left(title, 19)) || '…' ELSE coalesce(title, '') END, 'url', url, 'score', round(fit_score / 7.0, 2)) AS VARCHAR) AS link FROM jobs WHERE fit_score IS NOT NULL""",
        "career_expansion": """WITH r AS (SELECT source_key, regexp_extract(lower(url), '^([a-z]+://[^/?#]*)', 1) AS root, min({'t': first_seen_at, 'j': job_id}) AS at_first FROM jobs WHERE source_key IS NOT NULL GROUP BY 1, 2)
            SELECT source_key, count(DISTINCT root) * 18 AS n_candidates FROM (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY at_first) AS n FROM r) WHERE n <= 3 GROUP BY 1""",
        "prompt_budget_limits": f"SELECT doc_id, coalesce(list_filter([{', '.join(str(int(14_000 * 0.65**i)) for i in range(19))}], lambda x: ceil(least(length(text), x) / 4.0) <= 800)[1], 0) AS char_limit FROM documents",
    }
