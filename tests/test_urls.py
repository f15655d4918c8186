import posixpath
from urllib.parse import parse_qsl, urlencode, urlparse, urlunparse

import pytest
from pyspark.sql import functions as F

from trellium.functions import urls as U

CASES = [
    "HTTPS://Www.Firma.Example/Jobs/?utm_source=x&Q=a%20b&b&ref=1#f", "https://h.example/a;p=1?x=1", "https://h.example//x", "https://h.example/", "https://h.example", "//h.example/x", "mailto:a@b.example", "tel:1", "javascript:void(0)", "data:x",
    "ftp://h.example/", "https://", "https://facebook.com/x", "https://ex.com/", "https://h.example/x.PDF", "https://h.example/a/../b/./c//d/", "https://h.example/../..", "https://h.example/ä?ö=ü", "https://h.example/a?x=1&x=2&=3&y=", "https://h.example/a?FBCLID=1&GCLID=2",
    " https://h.example/a/b/ ", "https://h.example/a?b=c+d&e=*~", "", None,
]


def model(raw):
    if not raw or not raw.strip():
        return None
    p = urlparse(raw.strip())
    host = p.netloc.lower()
    path = p.path or "/"
    if p.scheme.lower() not in U.SCHEMES or not host or any(x in host for x in U.EXCLUDED_HOST_PARTS) or any(path.lower().endswith(e) for e in U.EXCLUDED_EXTENSIONS):
        return None
    query = urlencode([(k, v) for k, v in parse_qsl(p.query, keep_blank_values=True) if k.lower() not in U.TRACKING_PARAMS])
    norm = posixpath.normpath(path)
    norm = "/" if norm == "." else norm
    norm = norm if norm == "/" else norm.rstrip("/")
    return urlunparse((p.scheme.lower(), host, norm, "", query, ""))


def test_clean_url_follows_the_rules_and_is_idempotent(spark):
    df = spark.createDataFrame([(c,) for c in CASES], "u string").select("u", U.clean_url("u").alias("c"))
    for r in df.withColumn("again", U.clean_url("c")).collect():
        assert r.c == model(r.u), r.u
        assert r.again == r.c


def test_redirects_and_bases(spark):
    rows = [
        ("https://duckduckgo.com/l/?uddg=https%3A%2F%2Fz.example%2Fb%3Futm_term%3D1%26k%3D2", None, "https://z.example/b?k=2"),
        ("https://www.google.com/url?q=https%3A%2F%2Fz.example%2Fa%2F&x=1", None, "https://z.example/a"),
        ("/x?y=1", "https://h.example/a/b", "https://h.example/x?y=1"),
        ("c", "https://h.example/a/b", "https://h.example/a/c"),
        ("//o.example/q", "https://h.example/a", "https://o.example/q"),
        ("?p=2", "https://h.example/a", "https://h.example/a?p=2"),
    ]
    df = spark.createDataFrame(rows, "u string, b string, want string")
    got = df.select("want", F.when(F.col("b").isNull(), U.clean_url("u")).otherwise(U.clean_url("u", F.col("b"))).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


@pytest.mark.parametrize("depth,want", [(0, "firma.example"), (1, "firma.example/jobs"), (2, "firma.example/jobs/x")])
def test_source_key(spark, depth, want):
    assert spark.range(1).select(U.source_key(F.lit("https://WWW.Firma.Example/Jobs/X/y"), depth)).head()[0] == want


def test_slug_and_search_address(spark):
    r = spark.range(1).select(U.query_slug(F.lit("Große Öfen & Co!")).alias("s"), U.query_slug(F.lit("??")).alias("d"), U.render_search_url(F.lit("a b*~ü"), F.lit("https://x/{query}/{query_slug}")).alias("r")).head()
    assert (r.s, r.d, r.r) == ("grosse-oefen-co", "jobs", "https://x/a+b%2A~%C3%BC/a-b-ue")


def test_denied_and_shapes(spark):
    df = spark.createDataFrame([("https://h/login", "x", True), ("https://h/a", "Jetzt bewerben", True), ("https://h/a", "jetzt bewerben hier", False), ("https://h/initiativbewerbung", None, True), ("https://h/jobs/1", "Job", False)], "u string, t string, want boolean")
    assert all(r.want == r.got for r in df.select("want", U.denied(F.col("u"), F.col("t")).alias("got")).collect())
