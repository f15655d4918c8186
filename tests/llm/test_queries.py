import os

import duckdb
import pytest

from trellium.llm import catalog
from trellium.llm.tokens import count_tokens, encoding

COLUMNS = {
    "p1_found": [("url", "string"), ("score_job_id", "bigint"), ("seen_job_id", "bigint"), ("evidence_job_id", "bigint")], "p2_found": [("url_a", "string"), ("url_b", "string")], "p3_found": [("job_id", "bigint"), ("place_id", "bigint")], "p4_found": [("source_key", "string"), ("job_id", "bigint")],
    "p6_found": [("company_a", "string"), ("company_b", "string")], "p7_found": [("page_id", "bigint")], "p10_found": [("doc_id", "bigint")],
}


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_runs_and_equals_its_sql(spark, sf, name):
    df = catalog.queries()[name](spark, sf)
    rows = df.collect()
    if name in COLUMNS:
        assert df.dtypes == COLUMNS[name]
    if name in catalog.sql():
        c = duckdb.connect()
        for f in os.listdir(sf):
            if f.endswith(".parquet"):
                p = f"{sf}/{f}"
                c.execute(f"create view {f[:-8]} as select * from '{p if os.path.isfile(p) else p + '/*.parquet'}'")
        r = c.execute(catalog.sql()[name])
        cols = [d[0] for d in r.description]
        assert sorted(tuple(str(x[k]) for k in sorted(cols)) for x in rows) == sorted(tuple(str(x[cols.index(k)]) for k in sorted(cols)) for x in r.fetchall())


def test_tokens_of_long_texts_are_those_of_the_whole(monkeypatch):
    import trellium.llm.tokens as K

    path = os.path.join(K.DEFAULT_DIR, K.VOCABULARY)
    text = "Wir prüfen Öltanks, don’t we? 12 345  Teile\n\n• größere  Abläufe " * 300
    want = len(encoding(path).encode_ordinary(text))
    monkeypatch.setattr(K, "PIECE", 500)
    assert count_tokens(text, path) == want
