"""URL expressions: cleaning, keys, parts. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the URL rules.
SCHEMES = ["http", "https"]
EXCLUDED_HOST_PARTS = ["facebook.com", "instagram.com", "youtube.com", "youtu.be", "twitter.com", "x.com", "tiktok.com", "pinterest."]
EXCLUDED_EXTENSIONS = [".pdf", ".jpg", ".jpeg", ".png", ".gif", ".svg", ".zip", ".tar", ".gz", ".mp4", ".mp3", ".avi", ".webp", ".doc", ".docx", ".xls", ".xlsx"]
TRACKING_PARAMS = ["utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "ref", "source", "fbclid", "gclid"]
CAREER_PATHS = [
    "/careers", "/career", "/jobs", "/en/careers", "/en/jobs", "/join-us", "/work-with-us", "/karriere", "/de/karriere", "/de/jobs",
    "/de/stellenangebote", "/stellenangebote", "/offene-stellen", "/jobsuche", "/arbeiten-bei-uns", "/de/arbeiten-bei-uns",
    "/de/karriere/stellenangebote", "/karriere/stellenangebote",
]

#: RFC 3986, appendix B, with the scheme's own alphabet.
_SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#([\s\S]*))?$"
_WS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}]+"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(x: Column, f) -> Column:
    """``f(x)`` with ``x`` computed once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def strip(x: Column | str) -> Column:
    """Trim white space of any kind at both ends."""
    return F.regexp_replace(_c(x), rf"^{_WS}|{_WS}$", "")


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, _SPLIT, n)


def url_scheme(url: Column | str) -> Column:
    return F.lower(_part(_c(url), 1))


def url_netloc(url: Column | str) -> Column:
    return _part(_c(url), 2)


def url_path(url: Column | str) -> Column:
    return _part(_c(url), 3)


def url_query(url: Column | str) -> Column:
    return _part(_c(url), 4)


def unquote(x: Column, plus: bool = False) -> Column:
    """Percent-decoding; a malformed text stays as it is."""
    ready = x if plus else F.replace(x, F.lit("+"), F.lit("%2B"))
    return F.when(x.contains("%") | (x.contains("+") if plus else F.lit(False)), F.coalesce(F.try_url_decode(ready), x)).otherwise(x)


def quote_plus(x: Column) -> Column:
    """Form encoding with the unreserved characters of RFC 3986."""
    return F.when(x.rlike(r"^[A-Za-z0-9_.\-~]*$"), x).otherwise(F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")))


def query_pairs(query: Column) -> Column:
    """array<struct<k,v>> of a query string, blanks and order kept."""
    pieces = F.filter(F.split(query, "&"), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unquote(F.regexp_extract(p, r"^([^=]*)", 1), plus=True).alias("k"),
            unquote(F.regexp_extract(p, r"^[^=]*=?([\s\S]*)$", 1), plus=True).alias("v"),
        ),
    )


def _clean_query(query: Column) -> Column:
    kept = F.filter(query_pairs(query), lambda p: ~F.lower(p["k"]).isin(TRACKING_PARAMS))
    encoded = F.array_join(F.transform(kept, lambda p: F.concat(quote_plus(p["k"]), F.lit("="), quote_plus(p["v"]))), "&")
    return F.when(query == "", F.lit("")).otherwise(encoded)


def normal_path(path: Column) -> Column:
    """POSIX normalisation: dots resolved, slashes collapsed (two leading ones stay), no trailing slash."""
    lead = F.when(path.rlike(r"^//(?!/)"), F.lit("//")).otherwise(F.lit("/"))
    simple = F.regexp_replace(F.regexp_replace(path, r"^/+", ""), r"/{2,}", "/")
    simple = F.regexp_replace(simple, r"/$", "")
    segments = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    stack = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
    )
    dotted = path.rlike(r"(^|/)\.{1,2}(/|$)")
    plain = path.startswith("/") & ~dotted & ~path.contains("//")
    body = F.when(dotted, F.array_join(stack, "/")).otherwise(simple)
    return F.when(plain, F.when(path == "/", path).otherwise(F.regexp_replace(path, "/$", ""))).otherwise(F.concat(lead, body))


def _unwrap_once(url: Column) -> Column:
    """The target of a search engine's redirect link, else the link itself."""
    host = F.lower(url_netloc(url))

    def target(key: str) -> Column:
        return let(
            F.filter(query_pairs(url_query(url)), lambda p: (p["k"] == key) & (p["v"] != "")),
            lambda hits: F.when(F.size(hits) > 0, F.element_at(hits, 1)["v"]).otherwise(url),
        )

    google = host.contains("google.") & (url_path(url) == "/url")
    return strip(F.when(host.contains("duckduckgo.com"), target("uddg")).when(google, target("q")).otherwise(url))


def resolve(base: Column, ref: Column) -> Column:
    """``ref`` against ``base``: absolute, scheme-relative, root-relative, query, fragment and plain relative forms."""
    root = F.concat(url_scheme(base), F.lit("://"), url_netloc(base))
    folder = F.regexp_replace(F.when(url_path(base) == "", F.lit("/")).otherwise(url_path(base)), r"[^/]*$", "")
    return (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), ref)
        .when(ref == "", base)
        .when(ref.startswith("//"), F.concat(url_scheme(base), F.lit(":"), ref))
        .when(ref.startswith("/"), F.concat(root, ref))
        .when(ref.startswith("#"), F.concat(F.regexp_replace(base, r"#[\s\S]*$", ""), ref))
        .when(ref.startswith("?"), F.concat(root, url_path(base), ref))
        .otherwise(F.concat(root, folder, ref))
    )


def unwrapped(url: Column) -> Column:
    """The target behind redirect links of two search engines, as many levels deep as the address names them."""
    levels = F.regexp_count(F.lower(url), F.lit(r"duckduckgo\.com|google\."))
    return F.when(levels > 0, F.aggregate(F.sequence(F.lit(1), levels), url, lambda v, _: _unwrap_once(v))).otherwise(url)


def clean_url(raw: Column | str, base: Column | None = None) -> Column:
    """Canonical form of a link, or NULL where it is not admissible.

    Scheme and host in lower case, path normalised, tracking parameters, path
    parameters and fragment dropped, other parameters kept in order and encoded
    anew; redirect links of two search engines are followed to their end.
    NULL for NULL, blanks, other schemes, no host, excluded hosts or files.
    """
    value = strip(raw)
    if base is not None:
        value = let(value, lambda v: resolve(base, v))
    return let(let(value, unwrapped), lambda v: let(_split(v), _compose))


def _split(url: Column) -> Column:
    path = F.regexp_replace(url_path(url), r";[^/]*$", "")
    return F.struct(url_scheme(url).alias("scheme"), F.lower(url_netloc(url)).alias("host"), path.alias("path"), url_query(url).alias("query"))


def _compose(parts: Column) -> Column:
    scheme, host = parts["scheme"], parts["host"]
    path = F.when(parts["path"] == "", F.lit("/")).otherwise(parts["path"])
    bad_host = host.rlike("|".join(p.replace(".", r"\.") for p in EXCLUDED_HOST_PARTS))
    bad_file = F.lower(path).rlike(r"\.(" + "|".join(e[1:] for e in EXCLUDED_EXTENSIONS) + ")$")
    query = let(_clean_query(parts["query"]), lambda q: F.when(q == "", q).otherwise(F.concat(F.lit("?"), q)))
    whole = F.concat(scheme, F.lit("://"), host, normal_path(path), query)
    return F.when(scheme.isin(SCHEMES) & (host != "") & ~bad_host & ~bad_file, whole)


def normal_domain(netloc: Column | str) -> Column:
    return F.regexp_replace(F.trim(F.lower(_c(netloc))), r"^www\.", "")


def url_domain(url: Column | str) -> Column:
    return normal_domain(url_netloc(url))


def source_key(url: Column | str, depth: int = 1) -> Column:
    """Domain with up to ``depth`` leading path segments."""
    segments = F.filter(F.split(url_path(url), "/"), lambda s: s != "")
    return F.concat_ws("/", url_domain(url), F.transform(F.slice(segments, 1, depth), F.lower)) if depth else url_domain(url)


def root_url(url: Column | str) -> Column:
    return F.concat(url_scheme(url), F.lit("://"), url_netloc(url), F.lit("/"))


def career_urls(url: Column | str) -> Column:
    """Distinct cleaned candidates of the career paths below the host."""
    root = F.regexp_replace(root_url(url), "/$", "")
    return F.array_distinct(F.filter(F.array(*[clean_url(F.concat(root, F.lit(p))) for p in CAREER_PATHS]), lambda u: u.isNotNull()))


def query_slug(q: Column | str) -> Column:
    x = F.lower(_c(q))
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        x = F.replace(x, F.lit(a), F.lit(b))
    x = F.regexp_replace(F.regexp_replace(x, r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(x == "", F.lit("jobs")).otherwise(x)


def render_search_url(q: Column | str, template: Column) -> Column:
    """Fill {query}, {query_plus} and {query_slug} of a search template."""
    x = F.replace(template, F.lit("{query}"), quote_plus(_c(q)))
    x = F.replace(x, F.lit("{query_plus}"), quote_plus(_c(q)))
    return F.replace(x, F.lit("{query_slug}"), query_slug(q))


# Addresses and link texts that are never followed, and shapes of detail addresses.
DENIED_URLS = [
    r"/career/(zh|ja|ko|fr|it|es|pt|pl|cs|hu|ru|tr|nl|sv|fi|da|no)([_/]|$)", r"linkedin\.com/(signup|legal|feed|checkpoint|authwall|uas/login)", r"/signup", r"/login", r"/signin", r"/sign-in", r"/account", r"/checkout", r"/cart",
    r"/apply/submit", r"/application/submit", r"/anmelden", r"/einloggen", r"/konto", r"/registrieren", r"/bewerbung/absenden", r"/bewerben/absenden", r"initiativbewerbung", r"initativbewerbung", r"initiative[-_ ]?application",
    r"speculative[-_ ]?application", r"unsolicited[-_ ]?application", r"spontanbewerbung", r"spontaneous[-_ ]?application", r"talent[-_ ]?pool", r"talent[-_ ]?community", r"general[-_ ]?application",
]
DENIED_TEXTS = [
    r"^apply now$", r"^submit application$", r"^log in$", r"^sign in$", r"^register$", r"^jetzt bewerben$", r"^bewerben$", r"^bewerbung absenden$", r"^anmelden$", r"^einloggen$", r"^registrieren$", r"initiativbewerbung", r"initativbewerbung",
    r"initiative application", r"speculative application", r"unsolicited application", r"spontanbewerbung", r"spontaneous application", r"talent pool", r"talent community", r"general application",
]
DETAIL_URLS = [
    r"linkedin\.com/jobs/view/", r"indeed\.[^/]+/viewjob\?", r"/jobs/view/", r"/jobs/detail/", r"/job-detail", r"/jobdetail", r"/jobad", r"/stellenangebot/", r"/stellenanzeige/", r"/stellenangebote--",
    r"/(job|jobs|position|positions|vacancy|opening|stellenangebot|stellenanzeige|stelle)[-/][0-9a-z_-]{8,}", r"/(job|jobs|positions?)/[^/?#]*[0-9][^/?#]*",
    r"(jobid|job_id|requisition|reqid|jobposting|posting|stellenid|stellennummer|jobnumber|jk)=", r"(greenhouse\.io|lever\.co|workdayjobs\.com|smartrecruiters\.com|personio\.de|join\.com|teamtailor\.com)",
]
INDEX_URLS = [
    r"/stellensuche(\.html)?($|[?#])", r"/job-search(\.html)?($|[?#])", r"/jobs/search($|[/?#])", r"/jobs/?($|[?#])", r"/stellenangebote/?($|[?#])", r"/stellenanzeigen/?($|[?#])", r"/jobs/in-", r"/jobs/[^/?#]+/in-", r"/career/?$", r"/careers/?$",
    r"/career/.*/home(\.html)?$", r"/career/.*/standorte/", r"/career/.*/locations/", r"/standorte/", r"/locations/",
]
# Words that tell nothing in a slug, and parameters that only arrange a listing.
GENERIC_SLUG_WORDS = ["job", "jobs", "career", "careers", "karriere", "stellen", "stellenangebote", "stellenangebot", "angebote", "html", "de", "en", "mwd", "wmd", "fmd", "all", "genders", "muenchen", "munich", "germany", "deutschland"]
LISTING_KEYS = ["sort", "sortdir", "showfavorites", "change_c", "locale", "language", "lang"]


def alternation(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def denied(url: Column, text: Column) -> Column:
    """Whether a link must not be followed, by its address or its text."""
    urls, texts = "(?i)" + alternation(DENIED_URLS), "(?i)" + alternation(DENIED_TEXTS)
    t = F.coalesce(text, F.lit(""))
    return url.rlike(urls) | t.rlike(urls) | t.rlike(texts)


# Further shapes of addresses that are no detail pages.
NO_DETAIL = [r"initiativbewerbung", r"initativbewerbung", r"spontaneous[-_ ]application", r"speculative[-_ ]application", r"unsolicited[-_ ]application", r"talent[-_ ]pool", r"talent[-_ ]community", r"spontanbewerbung"]


def probable_detail(url: Column, title: Column, names_role: Column) -> Column:
    """Whether an address is a detail page: never one of a listing or an open application, surely one of a known shape, else one of two path segments that names a role."""
    both = F.concat(url, F.lit("\n"), F.coalesce(title, F.lit("")))
    deep = F.size(F.filter(F.split(url_path(url), "/"), lambda s: s != "")) >= 2
    return F.when(both.rlike("(?i)" + alternation([*INDEX_URLS, *NO_DETAIL])), F.lit(False)).when(both.rlike("(?i)" + alternation(DETAIL_URLS)), F.lit(True)).otherwise(deep & names_role & ~index_like(url))


def detail_like(url: Column) -> Column:
    return url.rlike("(?i)" + alternation(DETAIL_URLS))


def index_like(url: Column) -> Column:
    return url.rlike("(?i)" + alternation(INDEX_URLS))


def readable_slug(url: Column) -> Column:
    """Whether the last path segment holds two telling words."""
    last = F.element_at(F.split(F.regexp_replace(F.lower(unquote(url_path(url))), "/+$", ""), "/"), -1)
    tokens = F.regexp_extract_all(last, F.lit("([a-zäöüß]{3,})"), F.lit(1))
    return F.size(F.filter(tokens, lambda t: ~t.isin(GENERIC_SLUG_WORDS))) >= 2


def unfocused_listing(url: Column, has_role: Column) -> Column:
    """Whether a query string only sorts, filters or switches a listing, with no role named."""

    def judge(pairs: Column) -> Column:
        filled = F.filter(pairs, lambda p: p["v"] != "")
        keys = F.transform(filled, lambda p: F.lower(p["k"]))
        wildcard = F.exists(filled, lambda p: F.trim(p["v"]).isin("*", "%2a", "%2A"))
        only_listing = F.forall(keys, lambda k: k.isin(LISTING_KEYS))
        return (F.size(keys) > 0) & ((F.array_contains(keys, "term") & wildcard) | only_listing | F.array_contains(keys, "showfavorites") | F.array_contains(keys, "change_c"))

    return let(query_pairs(url_query(url)), judge) & ~has_role


def hint_score(url: Column, text: Column, hints: list[tuple[str, float]]) -> Column:
    """struct(score, reason): weights of the distinct hints found, and the first five of them."""
    first: dict[str, tuple[str, float]] = {}
    for term, weight in hints:
        key = term.strip().lower()
        if key:
            first.setdefault(key, (term, weight))
    table = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(t).alias("term"), F.lit(float(w)).alias("weight")) for k, (t, w) in first.items()])
    hay = F.lower(F.concat(url, F.lit(" "), F.coalesce(text, F.lit(""))))
    found = let(hay, lambda h: F.filter(table, lambda t: h.contains(t["key"])))
    return let(
        found,
        lambda a: F.struct(F.aggregate(a, F.lit(0.0), lambda s, t: s + t["weight"]).alias("score"), F.array_join(F.slice(F.transform(a, lambda t: t["term"]), 1, 5), ", ").alias("reason")),
    )
