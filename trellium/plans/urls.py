"""URL operators over all stored addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trellium.functions import urls as U
from trellium.functions.html import anchors
from trellium.operators.keyed import computed
from trellium.plans.sqlgen import clean_url_sql, part_sql, path_sql
from trellium.plans.tables import table
from trellium.session import spread

HINTS = [("job", 1.0), ("jobs", 1.0), ("career", 1.0), ("karriere", 1.0), ("vacanc", 1.0), ("stellen", 1.0), ("emplois", 1.0), ("engineer", 0.75), ("einkäufer", 0.75), ("controller", 0.75), ("detail", 0.5)]
TEMPLATES = ["https://suche.example/q?s={query}", "https://board.example/jobs/{query_slug}/all", "https://board.example/find?q={query_plus}&sort=new"]
ROLES = ["engineer", "einkaeufer", "controller", "planner"]


def _addresses(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select(F.explode(F.array("url", "final_url", "discovered_from")).alias("url"))
    return pages.unionByName(table(spark, d, "frontier").select("url")).filter("url is not null").distinct()


def url_split(spark, d):
    u = F.col("url")
    return _addresses(spark, d).select("url", U.url_scheme(u).alias("scheme"), U.url_netloc(u).alias("netloc"), U.url_path(u).alias("path"), U.url_query(u).alias("query"))


def url_clean(spark, d):
    return _addresses(spark, d).select("url", U.clean_url("url").alias("cleaned"))


def url_domain(spark, d):
    a = _addresses(spark, d).select(U.url_domain("url").alias("domain"))
    return a.groupBy("domain").agg(F.count("*").alias("n_urls"))


def url_path_normalise(spark, d):
    p = U.url_path(F.col("url"))
    return _addresses(spark, d).select("url", F.when(p == "", "/").otherwise(U.normal_path(p)).alias("path"))


def source_keys(spark, d):
    return _addresses(spark, d).select("url", *[U.source_key(F.col("url"), n).alias(f"key_{n}") for n in range(3)])


def url_root(spark, d):
    return _addresses(spark, d).select(U.root_url("url").alias("root")).groupBy("root").agg(F.count("*").alias("n_urls"))


def career_candidates(spark, d):
    roots = _addresses(spark, d).select(U.root_url("url").alias("root")).filter("root rlike '^https?://[^/]+/$'").distinct()
    return roots.select("root", F.explode(U.career_urls("root")).alias("candidate"))


def same_domain_links(spark, d):
    p = table(spark, d, "pages").filter("discovered_from is not null")
    return p.select("page_id", (U.url_domain("url") == U.url_domain("discovered_from")).alias("same_domain"))


def query_slug(spark, d):
    return table(spark, d, "queries").select("query", U.query_slug("query").alias("slug"))


def search_url_render(spark, d):
    q = table(spark, d, "queries").select("query", F.explode(F.array(*[F.lit(t) for t in TEMPLATES])).alias("template"))
    return q.select("query", "template", U.render_search_url("query", F.col("template")).alias("search_url"))


def url_safety_deny(spark, d):
    return table(spark, d, "pages").select("page_id", F.coalesce(U.denied(F.col("url"), F.col("title")), F.lit(False)).alias("denied"))


def detail_url(spark, d):
    u = F.col("url")
    return _addresses(spark, d).select("url", U.detail_like(u).alias("detail"), U.index_like(u).alias("listing"))


def readable_slug(spark, d):
    return _addresses(spark, d).select("url", U.readable_slug(F.col("url")).alias("readable"))


def listing_filter(spark, d):
    role = F.lower("url").rlike("|".join(ROLES))
    return _addresses(spark, d).select("url", U.unfocused_listing(F.col("url"), role).alias("unfocused"))


def _links(spark, d) -> DataFrame:
    """Anchors of a page text made of each page's own addresses."""
    part = lambda c: F.concat(F.lit('<li><a class="x" href="'), F.coalesce(F.col(c), F.lit("")), F.lit('"> <b>'), F.coalesce(F.regexp_replace("title", "[<>&]", ""), F.lit("")), F.lit("</b>\n</a></li>"))
    html = F.concat(F.lit("<ul>"), part("url"), part("final_url"), part("discovered_from"), F.lit("</ul>"))
    pages = spread(table(spark, d, "pages").select("page_id", "url", "final_url", "discovered_from", "title")).select("page_id", F.col("url").alias("page_url"), html.alias("html"))
    return pages.select("page_id", "page_url", F.posexplode(anchors(F.col("html"))).alias("pos", "a")).select("page_id", "page_url", "pos", "a.href", "a.text")


def link_extract(spark, d):
    return _links(spark, d).select("page_id", "pos", "href", "text")


def link_rank_topk(spark, d):
    """Links of each page: cleaned, allowed, hinted, first of equal ones, best 2."""
    return _best_links(_links(spark, d), 2)


def link_rank_top80(spark, d):
    """The same, best 80."""
    return _best_links(_links(spark, d), 80)


def _best_links(links: DataFrame, k: int) -> DataFrame:
    links = computed(links, "link", U.clean_url("href")).filter("link is not null").filter(~U.denied(F.col("link"), F.col("text")))
    links = computed(links, "h", U.hint_score(F.col("link"), F.col("text"), HINTS)).filter("h.score > 0")
    links = links.withColumn("score", F.col("h.score") + F.when(U.url_domain("link") == U.url_domain("page_url"), 0.25).otherwise(0.0))
    links = links.repartition("page_id")  # serves both windows
    first = F.row_number().over(Window.partitionBy("page_id", "link").orderBy("pos"))
    links = links.withColumn("n", first).filter("n = 1")
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "pos"))
    return links.withColumn("rank", rank).filter(F.col("rank") <= k).select("page_id", "rank", "link", "score")


def link_hint_score(spark, d):
    h = U.hint_score(F.col("url"), F.col("title"), HINTS)
    return table(spark, d, "pages").select("page_id", h.alias("h")).select("page_id", "h.score", "h.reason")


def queries():
    return {
        "url_split": url_split, "url_clean": url_clean, "url_domain": url_domain, "url_path_normalise": url_path_normalise, "source_key_levels": source_keys, "url_root": url_root, "career_candidates": career_candidates, "same_domain_links": same_domain_links,
        "query_slug": query_slug, "search_url_render": search_url_render, "url_safety_deny": url_safety_deny, "detail_url": detail_url, "readable_slug": readable_slug, "listing_filter": listing_filter, "link_extract": link_extract,
        "link_rank_topk": link_rank_topk, "link_rank_top80": link_rank_top80, "link_hint_score": link_hint_score,
    }


def sql() -> dict[str, str]:
    addresses = "(SELECT DISTINCT url FROM (SELECT url FROM pages UNION ALL SELECT final_url FROM pages UNION ALL SELECT discovered_from FROM pages UNION ALL SELECT url FROM frontier) WHERE url IS NOT NULL)"
    scheme, netloc, path, query = f"lower({part_sql('url', 1)})", part_sql("url", 2), part_sql("url", 3), part_sql("url", 4)
    domain = lambda x: f"regexp_replace(trim(lower({part_sql(x, 2)})), '^www\\.', '')"
    segments = f"list_filter(string_split({path}, '/'), lambda s: s <> '')"
    key = lambda n: f"array_to_string(list_concat([{domain('url')}], list_transform({segments}[1:{n}], lambda s: lower(s))), '/')"
    fold = "replace(replace(replace(replace(lower(query), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')"
    slug = f"CASE WHEN trim(regexp_replace({fold}, '[^a-z0-9]+', '-', 'g'), '-') = '' THEN 'jobs' ELSE trim(regexp_replace({fold}, '[^a-z0-9]+', '-', 'g'), '-') END"
    plus = "replace(url_encode(query), '%20', '+')"
    templates = ", ".join(f"('{t}')" for t in TEMPLATES)
    denied_url, denied_text = U.alternation(U.DENIED_URLS), U.alternation(U.DENIED_TEXTS)
    last = f"list_last(string_split(regexp_replace(lower(url_decode({path})), '/+$', ''), '/'))"
    generic = ", ".join(f"'{w}'" for w in U.GENERIC_SLUG_WORDS)
    pairs = f"list_filter(list_transform(list_filter(string_split({query}, '&'), lambda s: s <> ''), lambda s: {{'k': lower(regexp_extract(s, '^([^=]*)', 1)), 'v': url_decode(replace(regexp_extract(s, '^[^=]*=?(.*)$', 1), '+', ' '))}}), lambda p: p.v <> '')"
    keys = "list_transform(pairs, lambda p: p.k)"
    listing = ", ".join(f"'{k}'" for k in U.LISTING_KEYS)
    table_sql = "[" + ", ".join(f"{{'k': '{t}', 'w': {w}}}" for t, w in HINTS) + "]"
    found = lambda u, t: f"list_filter({table_sql}, lambda h: contains(lower({u} || ' ' || coalesce({t}, '')), h.k))"
    score = lambda u, t: f"CAST(coalesce(list_sum(list_transform({found(u, t)}, lambda h: h.w)), 0) AS DOUBLE)"
    title = "trim(regexp_replace(coalesce(regexp_replace(title, '[<>&]', '', 'g'), ''), '\\s+', ' ', 'g'))"
    links = f"""(SELECT page_id, page_url, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS INTEGER) AS pos, href, text FROM (
        SELECT page_id, url AS page_url, 1 AS k, url AS href, {title} AS text FROM pages UNION ALL SELECT page_id, url, 2, final_url, {title} FROM pages UNION ALL SELECT page_id, url, 3, discovered_from, {title} FROM pages) WHERE href <> '')"""
    return {
        "url_split": f"SELECT url, {scheme} AS scheme, {netloc} AS netloc, {path} AS path, {query} AS query FROM {addresses}",
        "url_clean": f"SELECT url, {clean_url_sql('url')} AS cleaned FROM {addresses}",
        "url_domain": f"SELECT {domain('url')} AS domain, count(*) AS n_urls FROM {addresses} GROUP BY 1",
        "url_path_normalise": f"SELECT url, CASE WHEN {path} = '' THEN '/' ELSE {path_sql(path)} END AS path FROM {addresses}",
        "source_key_levels": f"SELECT url, {domain('url')} AS key_0, {key(1)} AS key_1, {key(2)} AS key_2 FROM {addresses}",
        "url_root": f"SELECT {scheme} || '://' || {netloc} || '/' AS root, count(*) AS n_urls FROM {addresses} GROUP BY 1",
        "career_candidates": f"""WITH r AS (SELECT DISTINCT {scheme} || '://' || {netloc} || '/' AS root FROM {addresses}), c AS (SELECT root, unnest([{', '.join(f"'{p}'" for p in U.CAREER_PATHS)}]) AS p FROM r WHERE regexp_matches(root, '^https?://[^/]+/$'))
            SELECT DISTINCT root, candidate FROM (SELECT root, {clean_url_sql("(regexp_replace(root, '/$', '') || p)")} AS candidate FROM c) WHERE candidate IS NOT NULL""",
        "same_domain_links": f"SELECT page_id, {domain('url')} = {domain('discovered_from')} AS same_domain FROM pages WHERE discovered_from IS NOT NULL",
        "query_slug": f"SELECT query, {slug} AS slug FROM queries",
        "search_url_render": f"SELECT query, template, replace(replace(replace(template, '{{query}}', {plus}), '{{query_plus}}', {plus}), '{{query_slug}}', {slug}) AS search_url FROM queries, (VALUES {templates}) t(template)",
        "url_safety_deny": f"SELECT page_id, coalesce(regexp_matches(url, '(?i){denied_url}') OR regexp_matches(coalesce(title, ''), '(?i){denied_url}') OR regexp_matches(coalesce(title, ''), '(?i){denied_text}'), false) AS denied FROM pages",
        "detail_url": f"SELECT url, regexp_matches(url, '(?i){U.alternation(U.DETAIL_URLS)}') AS detail, regexp_matches(url, '(?i){U.alternation(U.INDEX_URLS)}') AS listing FROM {addresses}",
        "readable_slug": f"SELECT url, len(list_filter(regexp_extract_all({last}, '[a-zäöüß]{{3,}}'), lambda t: t NOT IN ({generic}))) >= 2 AS readable FROM {addresses}",
        "listing_filter": f"""SELECT url, len({keys}) > 0 AND ((list_contains({keys}, 'term') AND len(list_filter(pairs, lambda p: trim(p.v) IN ('*', '%2a', '%2A'))) > 0) OR len(list_filter({keys}, lambda k: k NOT IN ({listing}))) = 0
            OR list_contains({keys}, 'showfavorites') OR list_contains({keys}, 'change_c')) AND NOT regexp_matches(lower(url), '{"|".join(ROLES)}') AS unfocused FROM (SELECT url, {pairs} AS pairs FROM {addresses})""",
        "link_extract": f"SELECT page_id, pos, href, text FROM {links}",
        "link_rank_topk": f"""WITH c AS (SELECT *, {clean_url_sql('href')} AS link FROM {links}), s AS (SELECT *, {score('link', 'text')} AS base FROM c WHERE link IS NOT NULL AND NOT regexp_matches(link, '(?i){denied_url}') AND NOT regexp_matches(text, '(?i){denied_url}') AND NOT regexp_matches(text, '(?i){denied_text}')),
            f AS (SELECT *, base + CASE WHEN {domain('link')} = {domain('page_url')} THEN 0.25 ELSE 0 END AS score, row_number() OVER (PARTITION BY page_id, link ORDER BY pos) AS n FROM s WHERE base > 0)
            SELECT page_id, rank, link, score FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) AS rank FROM f WHERE n = 1) WHERE rank <= 2""",
        "link_rank_top80": f"""WITH c AS (SELECT *, {clean_url_sql('href')} AS link FROM {links}), s AS (SELECT *, {score('link', 'text')} AS base FROM c WHERE link IS NOT NULL AND NOT regexp_matches(link, '(?i){denied_url}') AND NOT regexp_matches(text, '(?i){denied_url}') AND NOT regexp_matches(text, '(?i){denied_text}')),
            f AS (SELECT *, base + CASE WHEN {domain('link')} = {domain('page_url')} THEN 0.25 ELSE 0 END AS score, row_number() OVER (PARTITION BY page_id, link ORDER BY pos) AS n FROM s WHERE base > 0)
            SELECT page_id, rank, link, score FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) AS rank FROM f WHERE n = 1) WHERE rank <= 80""",
        "link_hint_score": f"SELECT page_id, {score('url', 'title')} AS score, array_to_string(list_transform({found('url', 'title')}, lambda h: h.k)[1:5], ', ') AS reason FROM pages",
    }
