import os

from pyspark.sql import functions as F

from trellium.functions import budget as B
from trellium.functions.decode import query_suggestions
from trellium.functions.profile import profile_items, profile_lists
from trellium.functions.text import company_aliases, pattern_hits
from trellium.functions.urls import clean_url
from trellium.session import cut, scope


def test_limits_and_steps():
    limits = B.Limits(12_000, 5_000)
    assert (limits.margin, limits.prompt) == (600, 6_400)
    assert (B.Limits(4_000, 1_000).margin, B.Limits(100_000, 1_000).margin) == (350, 1200)
    tried = B.page_steps(limits, 120)
    assert tried[0]["links"] == 35 and tried[-1] == B.HARD_FLOOR and len(tried) == B.PAGE_TRIES + 1
    for a, b in zip(tried, tried[1:-1]):
        assert sum(a[k] != b[k] for k in a) == 1 and all(b[k] <= a[k] for k in a)
    assert B.page_steps(limits, 0)[0]["links"] == 0 and B.query_steps(limits)[-1] == B.QUERY_LEAST


def test_profiles_without_lines_headings_or_bullets(spark):
    rows = [(1, None), (2, ""), (3, "plain\n\nText: with colon, no heading at its end"), (4, "- Zoll\nRollen:\n* **Buyer**; Einkauf (alle)\n1. and Lager / Versand\n## Nicht\n• Nachtschicht\n- Skills:\n"), (4, "- Zoll")]
    df = spark.createDataFrame([(*r, "x") for r in rows[:4]], "id int, text string, section string")
    items = profile_items(df, "id", "text")
    assert [(r.line_no, r.section, r.bucket, r.term) for r in items.orderBy("line_no", "term_no").collect()] == [
        (0, "", "other", "Zoll"), (2, "rollen", "role", "**Buyer**"), (2, "rollen", "role", "Einkauf"), (3, "rollen", "role", "Lager"), (3, "rollen", "role", "Versand"), (5, "nicht", "avoid", "Nachtschicht"), (6, "nicht", "avoid", "Skills:"),
    ]
    lists = profile_lists(items, "id").collect()
    assert [(r.id, r.target_roles, r.role_signals, r.avoid_terms) for r in lists] == [(4, ["**Buyer**", "Einkauf", "Lager", "Versand"], ["**Buyer**", "Einkauf", "Lager", "Versand", "buyer"], ["Nachtschicht", "Skills"])]
    assert profile_items(df.limit(0), "id", "text").count() == 0


def test_suggestions_of_any_shape(spark):
    raws = [None, "", "no", '{"queries":null}', '{"queries":"x"}', '{"queries":["a",{"query":"b","reason":null},{"query":null},[1],true,""]}', '{"queries":["' + "q" * 500 + '"]}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, r string").orderBy("i")
    got = [[tuple(s) for s in x.q] for x in df.select(query_suggestions(F.col("r")).alias("q")).collect()]
    assert got == [[], [], [], [], [], [("a", ""), ("b", "")], [("q" * 400, "")]]


def test_aliases_and_patterns(spark):
    df = spark.createDataFrame([("Bayern Motor Werk AG",), ("A & B",), ("GmbH",), (None,)], "c string")
    assert [x.a for x in df.select(company_aliases("c").alias("a")).collect()] == [["bayern motor werk ag", "bayernmotorwerkag", "bayern", "bayern motor", "bayernmotor", "bmw"], ["a and b", "aandb", "a b"], ["gmbh"], []]
    assert [x.h for x in spark.createDataFrame([("EINKÄUFER 1",), (None,)], "t string").select(pattern_hits("t", ["(?i)einkäufer", "x", r"\d"]).alias("h")).collect()] == [["(?i)einkäufer", r"\d"], []]


def test_redirects_of_any_depth(spark):
    from urllib.parse import quote_plus

    want = "https://a.test/jobs?x=1"
    rows, url = [want], want
    for n in range(7):
        url = f"https://duckduckgo.com/l/?uddg={quote_plus(url)}" if n % 2 else f"https://www.google.de/url?q={quote_plus(url)}&sa=t"
        rows.append(url)
    df = spark.createDataFrame([(u,) for u in rows], "u string")
    assert [x.c for x in df.select(clean_url("u").alias("c")).collect()] == [want] * 8
    assert [x.c for x in spark.createDataFrame([("https://www.google.de/search?q=x",), (None,)], "u string").select(clean_url("u").alias("c")).collect()] == ["https://www.google.de/search?q=x", None]


def test_a_scope_drops_its_tables(spark):
    with scope(spark):
        kept = cut(spark.range(5), "scoped")
        path = kept.inputFiles()[0].split("/scoped-")[0].removeprefix("file://")
        assert kept.count() == 5 and any(f.startswith("scoped-") for f in os.listdir(path))
    assert not any(f.startswith("scoped-") for f in os.listdir(path))
