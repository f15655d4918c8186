from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellium.functions.decode import page_decision
from trellium.functions.html import anchors, json_ld
from trellium.functions.jsonld import embedded_leaves, json_ld_postings, postings_text
from trellium.operators.keyed import capped, insert_new, last_write, upsert
from trellium.sources.store import Store, append_events, export_csv, export_jsonl, read_seeds, robots_allow, with_schema


def test_store_swaps_generations(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}")
    schema = T.StructType.fromDDL("k string, v int")
    assert s.read("t", schema).count() == 0
    assert s.swap("t", spark.createDataFrame([("a", 1)], schema)) == 0
    assert s.swap("t", s.read("t").unionByName(spark.createDataFrame([("b", 2)], schema))) == 1
    assert s.swap("t", spark.createDataFrame([], schema), 1) == 1  # a generation is written once
    assert s.read("t").count() == 2


def test_exports_seeds_and_events(spark, tmp_path):
    df = spark.createDataFrame([(1, 'ä "x"\nz', None)], "n int, t string, e string")
    export_csv(df, f"{tmp_path}/c", True)
    export_jsonl(df, f"{tmp_path}/j", True)
    assert spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{tmp_path}/c").head().t == 'ä "x"\nz'
    assert '"e":null' in spark.read.text(f"{tmp_path}/j").head()[0]
    (tmp_path / "seeds.txt").write_text("# c\n\nhttps://b.example/\nhttps://a.example/x#1\nhttps://b.example\nmailto:x\n")
    assert [r.url for r in read_seeds(spark, f"{tmp_path}/seeds.txt").collect()] == ["https://b.example/", "https://a.example/x"]
    append_events(df, f"{tmp_path}/e", "saved", F.lit("2025-01-01").cast("timestamp"))
    assert spark.read.parquet(f"{tmp_path}/e").head().payload_json.startswith('{"n":1')


def test_keyed_operations(spark):
    base = spark.createDataFrame([("a", 1, "old"), ("b", 2, "old")], "k string, v int, f string")
    new = spark.createDataFrame([("b", 3, "new"), ("c", 4, "new")], "k string, v int, f string")
    assert sorted(map(tuple, upsert(base, new, "k", ["f"]).collect())) == [("a", 1, "old"), ("b", 3, "old"), ("c", 4, "new")]
    assert sorted(r.k for r in insert_new(base, new, "k").collect()) == ["a", "b", "c"]
    log = spark.createDataFrame([("a", 2, 9), ("a", 1, 5), (None, 1, 1)], "k string, t int, v int")
    assert [tuple(r) for r in last_write(log, "k", F.col("t"), {"v": F.min("v")}).collect()] == [("a", 2, 5)]
    assert capped(log.withColumn("k", F.lit("z")), "k", F.lit(2), [F.col("t"), F.col("v")], 25).count() == 2


def test_missing_columns_get_defaults(spark):
    got = with_schema(spark.createDataFrame([(None, 1)], "a string, x int"), T.StructType.fromDDL("a string, b string, c bigint"))
    assert tuple(got.head()) == ("", "", None)


def test_links_and_embedded_postings(spark):
    html = """<a href="/x"> A <b>&amp;</b> B</a><a href=''>no</a><A HREF='y'>Y
    </A><script type="application/ld+json">{"@graph":[{"@type":["JobPosting"],"title":"T","hiringOrganization":{"legalName":"C"},"url":"/p","jobLocation":[{"address":{"addressLocality":"L","addressCountry":"DE"}},{"address":"M"}]},{"@type":"jobposting","title":"t","url":"/p"}]}</script>
    <script type="application/ld+json">broken {</script>"""
    df = spark.createDataFrame([(html,), (None,)], "h string")
    r = df.select(anchors(F.col("h")).alias("a"), json_ld_postings(embedded_leaves(json_ld(F.col("h"))), F.lit("https://b.example/q")).alias("p")).collect()
    assert [(x.href, x.text) for x in r[0].a] == [("/x", "A & B"), ("y", "Y")]
    assert [(x.title, x.company, x.location, x.url) for x in r[0].p] == [("T", "C", "L, DE; M", "https://b.example/p")]
    assert r[1].p == []


def test_page_decision_of_noisy_replies(spark):
    raws = ['<think>{"x":1}</think>```json\n{"jobs":[{"title":"T","url":"u","fit_score":150},{"title":"","url":"v"}],"follow_urls":["a"," a ",""],"source_quality":"120"}\n```', "[1]", None, 'x {"jobs":null} y']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, r string").orderBy("i")
    got = [r.p for r in df.select(page_decision(F.col("r")).alias("p")).collect()]
    assert (got[0].jobs[0].fit_score, got[0].jobs[0].score_source, got[0].follow_urls, got[0].source_quality) == (100, "llm", ["a"], 100)
    assert got[1] is None and got[2] is None and got[3].jobs == []


def test_robots(spark):
    rules = "User-agent: *\nDisallow: /private\n"
    df = spark.createDataFrame([("https://h/private/x", rules), ("https://h/a", rules), ("https://h/a", None)], "u string, r string")
    assert [r[0] for r in df.select(robots_allow(F.col("u"), F.col("r"))).collect()] == [False, True, True]
    assert not df.filter("r is null").select(robots_allow(F.col("u"), F.col("r"), strict=True)).head()[0]


def test_postings_of_any_depth_and_shape(spark):
    deep = "[" * 300 + '{"type":"JOBPOSTING","title":"Deep","url":"d"}' + "]" * 300
    raws = [deep, '{"@type":"JobPosting","title":" ","url":"x"}', '{"@type":"JobPosting","title":"No address","jobLocation":"Here","hiringOrganization":["A",{"name":"B"}]}', '{"@type":"Event","title":"E"}', "7", ""]
    df = spark.createDataFrame([(raws, "https://a.test/p/q"), ([], "https://a.test/")], "r array<string>, b string")
    rows = df.select(json_ld_postings(embedded_leaves(F.col("r")), F.col("b")).alias("p")).select("p", postings_text(F.col("p")).alias("t"), postings_text(F.col("p"), 1).alias("one")).collect()
    assert [(x.title, x.company, x.location, x.url) for x in rows[0].p] == [("Deep", "", "", "https://a.test/p/d"), ("No address", "A, B", "Here", "https://a.test/p/q")]
    assert rows[0].t.splitlines()[:3] == ["STRUCTURED JOBPOSTING DATA:", "1. Title: Deep", "   URL: https://a.test/p/d"] and "2. Title: No address" in rows[0].t
    assert "2." not in rows[0].one and rows[1].t == ""
