"""Prompt texts: profiles, budgets, suggested and templated queries, aliases, united lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trellium.functions import budget as B
from trellium.functions import text as T
from trellium.functions.decode import query_suggestions
from trellium.functions.profile import ROLE_TOKENS, SECTION_WORDS, profile_items, profile_lists
from trellium.functions.urls import DETAIL_URLS, INDEX_URLS, NO_DETAIL, alternation, clean_url, probable_detail, render_search_url
from trellium.operators.keyed import computed
from trellium.plans.sqlgen import clean_url_sql, part_sql
from trellium.plans.tables import table

LIMITS = B.Limits(12_000, 5_000)
OVERHEAD, LINK_CHARS = 1_500, 40
PATTERNS = ["(?i)engineer", "(?i)einkäufer|buyer", r"(?i)\bsenior\b", "^Lead ", "[0-9]"]
ROLES = ["engineer", "einkaeufer", "controller", "planner"]
#: Templates of first queries and of search pages.
QUERY_TEMPLATES = [
    "{roles} jobs {location} careers", "{roles} {location} job openings", "{roles} {location} greenhouse lever workday personio", "{role_terms} Stellenangebote {location_terms}", "{role_terms} Karriere {location_terms}", "{expertise_terms} {location_terms} jobs",
    "{expertise_terms} {location_terms} Karriere", "site:greenhouse.io {roles} {location}", "site:lever.co {roles} {location}", "site:personio.de {roles} {location}", "site:join.com {roles} {location}",
]
SEARCH_PAGES = ["https://suche.example/q/?s={query}&utm_source=x", "https://board.example/jobs/{query_slug}/", "https://board.example/jobs/{query_slug}", "ftp://old.example/{query}"]
VALUES = {"roles": "Engineer Controller", "role_terms": "Einkäufer", "expertise_terms": "Einkäufer"}


def _markdown(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their short lines as headings, the first of them named for a bucket by the number of the document."""
    names = F.array(*[F.lit(n) for n in ("Target Roles:", "## **Avoid**", "Search", "Fit signals:", "# Skills")])
    body = F.regexp_replace("text", r"(?m)^([^.!?|•:\r\n]{3,40})\r?$", "# $1")
    return table(spark, d, "documents").select("doc_id", F.concat(F.element_at(names, (F.col("doc_id") % 5 + 1).cast("int")), F.lit("\n- Strategic Buyer / Einkäufer (m/w/d); and sourcing\n  2) Lead buyer \n"), body).alias("text"))


def profile_sections(spark, d):
    return profile_items(_markdown(spark, d), "doc_id", "text").select("doc_id", "line_no", "section", "bucket", "term_no", "term")


def profile_terms(spark, d):
    lists = profile_lists(profile_items(_markdown(spark, d), "doc_id", "text"), "doc_id")
    return lists.select("doc_id", *[F.array_join(c, "|").alias(c) for c in lists.columns if c != "doc_id"])


def prompt_budget_full(spark, d):
    """Limits of links, text, memory and profile under which a page prompt fits, and how far they had to shrink."""
    tried = [(n, [tuple(s[k] for k in ("links", "text", "memory", "profile")) for s in B.page_steps(LIMITS, n)]) for n in range(LIMITS.most["links"] + 1)]
    known = spark.createDataFrame(tried, "n_links int, tried array<struct<links:int,text:int,memory:int,profile:int>>")
    docs = table(spark, d, "documents").select("doc_id", F.col("n_chars"), F.least(F.col("doc_id") % 60, F.lit(LIMITS.most["links"])).cast("int").alias("n_links"), (F.length(F.coalesce("url", F.lit(""))) + LINK_CHARS).alias("link_chars"))
    n = F.col("n_chars")
    fixed = F.lit(OVERHEAD) + F.floor(n / 2)
    size = lambda s: B.tokens(fixed + F.least(n, s["text"]) + F.least(n * 2, s["memory"]) + F.least(n * 3, s["profile"]) + s["links"] * F.col("link_chars"))
    sized = docs.join(F.broadcast(known), "n_links").withColumn("all", F.transform("tried", lambda s, i: F.struct(s.alias("s"), i.alias("step"), size(s).alias("n_tokens"))))
    fit = sized.withColumn("f", F.try_element_at(F.filter("all", lambda x: x["n_tokens"] <= LIMITS.prompt), F.lit(1)))
    outcome = F.when(F.col("f").isNull(), "error").when(F.col("f.step") == F.size("tried") - 1, "floor").when(F.col("f.step") == 0, "whole").otherwise("shrunk")
    return fit.select("doc_id", outcome.alias("outcome"), *[F.col(f"f.s.{k}").alias(k) for k in ("links", "text", "memory", "profile")], "f.n_tokens")


def query_prompt_budget(spark, d):
    """Limits of memory and profile of a query prompt; the last ones tried where none fit."""
    tried = B.query_steps(LIMITS)
    n = F.col("n_chars")
    chars = lambda s: F.lit(OVERHEAD) + F.floor(n / 2) + F.least(n * 2, s["memory"]) + F.least(n * 3, s["profile"])
    fit = table(spark, d, "documents").select("doc_id", F.col("n_chars"), B.first_fitting(tried, chars, LIMITS.prompt // 2).alias("f"))
    return fit.select("doc_id", *[F.coalesce(F.col(f"f.{k}"), F.lit(tried[-1][k])).alias(k) for k in ("memory", "profile")], F.col("f").isNotNull().alias("fits"))


def prompt_limits(spark, d):
    """What each context window leaves for a prompt if a quarter of it is kept for the reply."""
    w = table(spark, d, "context_windows").select("window_id", F.col("capacity_tokens").alias("window"))
    margin = F.least(F.greatest(F.floor(F.col("window") * 0.05), F.lit(350)), F.lit(1200))
    return w.select("window_id", margin.alias("margin"), (F.col("window") - F.floor(F.col("window") / 4) - margin).alias("prompt"))


def query_suggestions_decode(spark, d):
    """Suggested queries in replies made of the stored queries: texts, objects, numbers and blanks."""
    q = table(spark, d, "queries").select("query", "reason")
    item = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    reason = F.when(F.col("reason").isNull(), "null").otherwise(item(F.col("reason")))
    raw = F.concat(F.lit('Here you are: ```json {"queries":['), item(F.concat(F.lit("  "), "query", F.lit(" "))), F.lit(',{"query":'), item(F.col("query")), F.lit(',"reason":'), reason, F.lit('},7,{"reason":"x"},"  ",null,{"query":12}]} ```'))
    return q.select("query", F.posexplode(query_suggestions(raw)).alias("pos", "s")).select("query", "pos", F.col("s.query").alias("suggested"), F.col("s.reason").alias("reason"))


def bootstrap_queries(spark, d):
    """Query templates filled for every place; equal ones once."""
    g = table(spark, d, "gazetteer").select(F.col("place").alias("location"), F.coalesce("alt_name", "place").alias("location_terms"))
    t = spark.createDataFrame([(t,) for t in QUERY_TEMPLATES], "template string")
    filled = F.col("template")
    for name, value in VALUES.items():
        filled = F.replace(filled, F.lit("{" + name + "}"), F.lit(value))
    for name in ("location", "location_terms"):
        filled = F.replace(filled, F.lit("{" + name + "}"), F.col(name))
    return g.crossJoin(F.broadcast(t)).select(F.trim(filled).alias("query")).filter("query <> ''").distinct()  # two short lists


def search_urls(spark, d):
    """Cleaned search addresses of every stored query, in the order of the pages, equal ones once."""
    q = table(spark, d, "queries").select("query", F.array(*[clean_url(render_search_url("query", F.lit(p))) for p in SEARCH_PAGES]).alias("u"))
    return q.select("query", F.posexplode(F.array_distinct(F.filter("u", lambda u: u.isNotNull()))).alias("pos", "search_url"))


def company_aliases(spark, d):
    return table(spark, d, "jobs").select("company").filter("company is not null").distinct().select("company", F.array_join(T.company_aliases("company"), "|").alias("aliases"))


def pattern_hits(spark, d):
    return table(spark, d, "jobs").select("job_id", F.array_join(T.pattern_hits("title", PATTERNS), ";").alias("hits"))


def probable_details(spark, d):
    role = F.lower("url").rlike("|".join(ROLES))
    return table(spark, d, "pages").select("page_id", probable_detail(F.col("url"), F.col("title"), role).alias("detail"))


def term_union(spark, d):
    """Words of title, company and location as one list, the first of equal ones in any case kept."""
    words = lambda c: F.split(F.coalesce(F.col(c), F.lit("")), r"\s+")
    return table(spark, d, "jobs").select("job_id", F.array_join(T.unique_items(F.concat(words("title"), words("company"), words("location"))), "|").alias("terms"))


def postings_union(spark, d):
    """Saved postings, then visited pages, as one list: of each cleaned address the first with a title, postings before pages."""
    jobs = table(spark, d, "jobs").select(F.lit(0).alias("source_rank"), F.col("job_id").alias("row_id"), "url", "title")
    pages = table(spark, d, "pages").select(F.lit(1).alias("source_rank"), F.col("page_id").alias("row_id"), "url", "title")
    rows = computed(jobs.unionByName(pages), "address", clean_url("url")).filter("address is not null and trim(title) <> ''")
    return rows.groupBy("address").agg(F.min(F.struct("source_rank", "row_id", "title")).alias("first")).select("address", "first.*")


def queue_counters(spark, d):
    """Addresses and queries queued by month, negative counts as none."""
    f = table(spark, d, "frontier").groupBy(F.date_format("queued_at", "yyyy-MM").alias("month")).agg(F.sum(F.greatest(F.lit(0), F.signum(F.coalesce("depth", F.lit(0)) + 1).cast("bigint"))).alias("enqueued"))
    q = table(spark, d, "queries").groupBy(F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.sum(F.greatest(F.lit(0).cast("bigint"), F.coalesce("uses", F.lit(0)))).alias("queries_used"))
    zero = F.lit(0).cast("bigint")
    return f.join(q, "month", "full").select("month", F.coalesce("enqueued", zero).alias("enqueued"), F.coalesce("queries_used", zero).alias("queries_used"))


def ranked_reasons(spark, d):
    """Reasons of a source's queue entries in order, and the one of the lowest priority, the first of equals."""
    q = table(spark, d, "frontier").filter("source_key is not null and reason is not null")
    return q.groupBy("source_key").agg(F.array_join(F.array_sort(F.collect_set("reason")), "|").alias("reasons"), F.min(F.when(F.col("priority").isNotNull(), F.struct("priority", "item_id", "reason")))["reason"].alias("binding"))


def queries():
    return {
        "profile_sections": profile_sections, "profile_terms": profile_terms, "prompt_budget_full": prompt_budget_full, "query_prompt_budget": query_prompt_budget, "prompt_limits": prompt_limits, "query_suggestions_decode": query_suggestions_decode,
        "bootstrap_queries": bootstrap_queries, "search_urls": search_urls, "company_aliases": company_aliases, "pattern_hits": pattern_hits, "probable_details": probable_details, "term_union": term_union, "postings_union": postings_union,
        "queue_counters": queue_counters, "ranked_reasons": ranked_reasons,
    }


def _array(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql() -> dict[str, str]:
    split = "list_filter(list_transform(regexp_split_to_array(regexp_replace({x}, '\\([^)]*\\)', ' ', 'g'), '\\s+[/|]\\s+|\\s*[;,]\\s+'), lambda t: trim(regexp_replace(trim(t), '(?i)^(and|or|oder|und)\\s+', ''))), lambda t: length(t) >= 2)"
    markdown = """(SELECT doc_id, ['Target Roles:', '## **Avoid**', 'Search', 'Fit signals:', '# Skills'][doc_id % 5 + 1] || chr(10) || '- Strategic Buyer / Einkäufer (m/w/d); and sourcing' || chr(10) || '  2) Lead buyer ' || chr(10) ||
      regexp_replace(text, '(?m)^([^.!?|•:\\r\\n]{3,40})\\r?$', '# \\1', 'g') AS text FROM documents)"""
    heading = "(starts_with(line, '#') OR (regexp_matches(line, '^[^\\-*].*:$', 's') AND length(line) < 80))"
    key = "lower(regexp_replace(trim(replace(regexp_replace(line, '^#+\\s*', ''), '**', '')), ':+$', ''))"
    words = " ".join(f"WHEN {' OR '.join(f"contains(section, '{k}')" for k in keys)} THEN '{name}'" for name, keys in SECTION_WORDS.items())
    items = f"""l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\r\\n|\\n|\\r')) AS raw, generate_subscripts(regexp_split_to_array(text, '\\r\\n|\\n|\\r'), 1) - 1 AS line_no FROM {markdown}),
      t AS (SELECT doc_id, line_no, trim(regexp_replace(raw, '^\\s+|\\s+$', '', 'g')) AS line FROM l),
      f AS (SELECT *, {heading} AS head, coalesce(last_value(CASE WHEN {heading} THEN {key} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no), '') AS section FROM t WHERE line <> ''),
      b AS (SELECT *, regexp_extract(line, '^\\s*(?:[-*•]|[0-9]+[.)])\\s+(\\S.*?)\\s*$', 1, 's') AS item FROM f WHERE NOT head),
      x AS (SELECT doc_id, line_no, section, CASE {words} ELSE 'other' END AS bucket, {split.format(x="item")} AS terms FROM b WHERE item <> ''),
      i AS (SELECT doc_id, line_no, section, bucket, generate_subscripts(terms, 1) - 1 AS term_no, unnest(terms) AS term FROM x)"""
    tidy = "regexp_replace(regexp_replace({t}, '\\s+', ' ', 'g'), '^[\\s\\-–—:;,.•]+|[\\s\\-–—:;,.•]+$', '', 'g')"
    unique = lambda a: f"list_filter({a}, lambda t, n: t <> '' AND list_position(list_transform({a}, lambda u: lower(u)), lower(t)) = n)"
    tidied = lambda a: f"list_transform({a}, lambda t: {tidy.format(t='t')})"
    of = lambda names: f"coalesce(list({tidy.format(t='term')} ORDER BY line_no, term_no) FILTER (WHERE bucket IN ({names})), [])"
    most, least = LIMITS.most, LIMITS.least
    page_step = f"""SELECT n, step + 1, CASE WHEN links > {least['links']} THEN greatest({least['links']}, CAST(floor(links * CAST(0.65 AS DOUBLE)) AS INTEGER)) WHEN body <= {least['text']} AND memory <= 600 AND profile <= 1400 AND links > 3 THEN 3 ELSE links END,
        CASE WHEN links > {least['links']} THEN body WHEN body > {least['text']} THEN greatest({least['text']}, CAST(floor(body * CAST(0.65 AS DOUBLE)) AS INTEGER)) WHEN memory <= 600 AND profile <= 1400 AND links <= 3 AND body > 700 THEN 700 ELSE body END,
        CASE WHEN links > {least['links']} OR body > {least['text']} OR memory <= 600 THEN memory ELSE greatest(600, CAST(floor(memory * CAST(0.65 AS DOUBLE)) AS INTEGER)) END,
        CASE WHEN links > {least['links']} OR body > {least['text']} OR memory > 600 OR profile <= 1400 THEN profile ELSE greatest(1400, CAST(floor(profile * CAST(0.65 AS DOUBLE)) AS INTEGER)) END
        FROM s WHERE step < 17 AND (links > 3 OR body > 700 OR memory > 600 OR profile > 1400)"""
    page_tokens = f"CAST(ceil(({OVERHEAD} + n_chars // 2 + least(n_chars, body) + least(2 * n_chars, memory) + least(3 * n_chars, profile) + links * link_chars) / 4.0) AS BIGINT)"
    query_tokens = f"ceil(({OVERHEAD} + n_chars // 2 + least(2 * n_chars, memory) + least(3 * n_chars, profile)) / 4.0)"
    slug_fold = "replace(replace(replace(replace(lower(query), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')"
    slug = f"CASE WHEN trim(regexp_replace({slug_fold}, '[^a-z0-9]+', '-', 'g'), '-') = '' THEN 'jobs' ELSE trim(regexp_replace({slug_fold}, '[^a-z0-9]+', '-', 'g'), '-') END"
    plus = "replace(url_encode(query), '%20', '+')"
    pages = ", ".join(f"({i}, '{p}')" for i, p in enumerate(SEARCH_PAGES))
    rendered = f"replace(replace(page, '{{query}}', {plus}), '{{query_slug}}', {slug})"
    aliases = "trim(regexp_replace(replace(replace(translate(lower(company), '{a}', '{p}'), 'ß', 'ss'), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))".format(a=T._ACCENTED, p=T._PLAIN)
    template = "template"
    for name, value in VALUES.items():
        template = f"replace({template}, '{{{name}}}', '{value}')"
    template = f"replace(replace({template}, '{{location}}', place), '{{location_terms}}', coalesce(alt_name, place))"
    deep = f"len(list_filter(string_split({part_sql('url', 3)}, '/'), lambda s: s <> '')) >= 2"
    union_words = tidied("list_concat(regexp_split_to_array(coalesce(title, ''), '\\s+'), list_concat(regexp_split_to_array(coalesce(company, ''), '\\s+'), regexp_split_to_array(coalesce(location, ''), '\\s+')))")
    return {
        "profile_sections": f"WITH {items} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, section, bucket, CAST(term_no AS INTEGER) AS term_no, term FROM i",
        "profile_terms": f"""WITH {items},
          g AS (SELECT doc_id, {of("'role'")} AS roles, {of("'role', 'role_signal'")} AS signals, {of("'positive'")} AS positive, {of("'search', 'other'")} AS searched, {of("'avoid'")} AS avoided FROM i GROUP BY doc_id),
          h AS (SELECT *, {unique("roles")} AS target_roles, list_concat(signals, flatten(list_transform(roles, lambda r: list_filter({_array(ROLE_TOKENS)}, lambda k: contains(lower(r), k))))) AS all_signals, list_concat(positive, searched) AS all_positive FROM g),
          p AS (SELECT *, {unique("all_positive")} AS positive_terms FROM h),
          q AS (SELECT *, list_concat(searched, list_concat(target_roles, positive_terms)) AS all_search FROM p)
          SELECT doc_id, array_to_string(target_roles, '|') AS target_roles, array_to_string({unique("all_signals")}, '|') AS role_signals, array_to_string(positive_terms, '|') AS positive_terms,
            array_to_string({unique("avoided")}, '|') AS avoid_terms, array_to_string({unique("all_search")}, '|') AS search_terms FROM q""",
        "prompt_budget_full": f"""WITH RECURSIVE s(n, step, links, body, memory, profile) AS (SELECT CAST(range AS INTEGER), 0, CAST(range AS INTEGER), {most['text']}, {most['memory']}, {most['profile']} FROM range(0, {most['links'] + 1}) UNION ALL {page_step}),
          a AS (SELECT * FROM s UNION ALL SELECT CAST(range AS INTEGER), 99, least(CAST(range AS INTEGER), 2), 400, 500, 800 FROM range(0, {most['links'] + 1})),
          d AS (SELECT doc_id, n_chars, CAST(least(doc_id % 60, {most['links']}) AS INTEGER) AS n_links, length(coalesce(url, '')) + {LINK_CHARS} AS link_chars FROM documents),
          f AS (SELECT * FROM (SELECT doc_id, step, links, body, memory, profile, {page_tokens} AS n_tokens, row_number() OVER (PARTITION BY doc_id ORDER BY step) AS r FROM d JOIN a ON a.n = d.n_links WHERE {page_tokens} <= {LIMITS.prompt}) WHERE r = 1)
          SELECT d.doc_id, CASE WHEN f.step IS NULL THEN 'error' WHEN f.step = 99 THEN 'floor' WHEN f.step = 0 THEN 'whole' ELSE 'shrunk' END AS outcome, links, body AS text, memory, profile, n_tokens FROM d LEFT JOIN f ON f.doc_id = d.doc_id""",
        "query_prompt_budget": f"""WITH RECURSIVE s(step, memory, profile) AS (SELECT 0, {most['memory']}, {most['profile']} UNION ALL
            SELECT step + 1, CASE WHEN memory > 500 THEN greatest(500, CAST(floor(memory * CAST(0.6 AS DOUBLE)) AS INTEGER)) ELSE memory END, CASE WHEN memory > 500 OR profile <= 1200 THEN profile ELSE greatest(1200, CAST(floor(profile * CAST(0.6 AS DOUBLE)) AS INTEGER)) END
            FROM s WHERE step < 11 AND (memory > 500 OR profile > 1200)),
          f AS (SELECT doc_id, min({{'step': step, 'memory': memory, 'profile': profile}}) AS f FROM documents, s WHERE {query_tokens} <= {LIMITS.prompt // 2} GROUP BY doc_id)
          SELECT d.doc_id, coalesce(f.f.memory, 500) AS memory, coalesce(f.f.profile, 1200) AS profile, f.f IS NOT NULL AS fits FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id""",
        "prompt_limits": """SELECT window_id, least(greatest(capacity_tokens * 5 // 100, 350), 1200) AS margin, capacity_tokens - capacity_tokens // 4 - least(greatest(capacity_tokens * 5 // 100, 350), 1200) AS prompt FROM context_windows""",
        "query_suggestions_decode": """SELECT query, CAST(0 AS INTEGER) AS pos, left(trim(query), 400) AS suggested, '' AS reason FROM queries UNION ALL SELECT query, 1, left(trim(query), 400), left(trim(coalesce(reason, '')), 800) FROM queries UNION ALL SELECT query, 2, '12', '' FROM queries""",
        "bootstrap_queries": f"SELECT DISTINCT trim({template}) AS query FROM gazetteer, (SELECT unnest({_array(QUERY_TEMPLATES)}) AS template)",
        "search_urls": f"""WITH c AS (SELECT query, n, {clean_url_sql(rendered)} AS u FROM queries, (VALUES {pages}) p(n, page)), k AS (SELECT query, u, min(n) AS n FROM c WHERE u IS NOT NULL GROUP BY 1, 2)
          SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY n) - 1 AS INTEGER) AS pos, u AS search_url FROM k""",
        "company_aliases": f"""WITH w AS (SELECT company, {aliases} AS w FROM (SELECT DISTINCT company FROM jobs WHERE company IS NOT NULL)),
          t AS (SELECT *, list_filter(string_split(w, ' '), lambda x: x <> '' AND NOT list_contains({_array(T.ALIAS_STOP_WORDS)}, x)) AS t FROM w),
          a AS (SELECT company, list_filter(list_concat([w, replace(w, ' ', '')], list_concat(t[1:1], list_concat(CASE WHEN len(t) >= 2 THEN [array_to_string(t[1:2], ' '), array_to_string(t[1:2], '')] ELSE [] END, [array_to_string(list_transform(t, lambda x: left(x, 1)), '')]))), lambda x: length(x) >= 3) AS a FROM t)
          SELECT company, array_to_string(list_filter(a, lambda x, n: list_position(a, x) = n), '|') AS aliases FROM a""",
        "pattern_hits": f"SELECT job_id, array_to_string(list_filter({_array(PATTERNS)}, lambda p: regexp_matches(coalesce(title, ''), p)), ';') AS hits FROM jobs",
        "probable_details": f"""SELECT page_id, CASE WHEN regexp_matches(url || chr(10) || coalesce(title, ''), '(?i){alternation([*INDEX_URLS, *NO_DETAIL])}') THEN false WHEN regexp_matches(url || chr(10) || coalesce(title, ''), '(?i){alternation(DETAIL_URLS)}') THEN true
          ELSE {deep} AND regexp_matches(lower(url), '{"|".join(ROLES)}') AND NOT regexp_matches(url, '(?i){alternation(INDEX_URLS)}') END AS detail FROM pages""",
        "term_union": f"SELECT job_id, array_to_string({unique('a')}, '|') AS terms FROM (SELECT job_id, {union_words} AS a FROM jobs)",
        "postings_union": f"""WITH u AS (SELECT 0 AS source_rank, job_id AS row_id, url, title FROM jobs UNION ALL SELECT 1, page_id, url, title FROM pages), c AS (SELECT *, {clean_url_sql('url')} AS address FROM u WHERE trim(title) <> '')
          SELECT address, source_rank, row_id, title FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY source_rank, row_id) AS r FROM c WHERE address IS NOT NULL) WHERE r = 1""",
        "queue_counters": """WITH f AS (SELECT strftime(queued_at, '%Y-%m') AS month, CAST(sum(greatest(0, sign(coalesce(depth, 0) + 1))) AS BIGINT) AS n FROM frontier GROUP BY 1), q AS (SELECT strftime(created_at, '%Y-%m') AS month, CAST(sum(greatest(0, coalesce(uses, 0))) AS BIGINT) AS n FROM queries GROUP BY 1)
          SELECT month, coalesce(f.n, 0) AS enqueued, coalesce(q.n, 0) AS queries_used FROM f FULL JOIN q USING (month)""",
        "ranked_reasons": """SELECT source_key, string_agg(DISTINCT reason, '|' ORDER BY reason) AS reasons, (list(reason ORDER BY priority, item_id) FILTER (WHERE priority IS NOT NULL))[1] AS binding FROM frontier WHERE source_key IS NOT NULL AND reason IS NOT NULL GROUP BY 1""",
    }
