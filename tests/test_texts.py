import re

from pyspark.sql import functions as F

from trellium.functions.text import compacted
from trellium.plans import catalog

TERMS = ["contract", "vertrag", "salario", "lidí"]


def loop(text, head=180, relevant=240, most=14_000):
    lines = [s for s in (x.strip(" ") for x in re.split(r"\r\n|\n|\r", re.sub(r"[ \t]+", " ", text))) if s]
    hits = [s for s in lines if any(t in s.lower() for t in TERMS)][:relevant]
    return ("\n".join(lines[:head]) + ("\n\nLIKELY RELEVANT LINES:\n" + "\n".join(hits) if hits else ""))[:most]


TEXTS = ["", " a \t b \n\n Vertrag 1\r\nc\nVertrag 2\rd", "\n".join(f"{'Contract' if n % 3 else 'line'} {n}" for n in range(900)), "\n".join(f"{n} " + "x" * 300 for n in range(100))]


def test_registered_compaction_keeps_the_operators_limits(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.compact for r in catalog.queries()["page_text_compact_full"](spark, str(tmp_path)).collect()}
    assert got == {n: loop(t) for n, t in enumerate(TEXTS)}
    assert len(got[3]) == 14_000 and got[2].split("\n\n")[0].count("\n") == 179 and got[2].count("\n") == 179 + 2 + 240


def test_small_limits(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "n int, text string")
    got = dict(map(tuple, df.select("n", compacted(F.col("text"), TERMS, head=2, relevant=1, most=60)).collect()))
    assert got == {n: loop(t, 2, 1, 60) for n, t in enumerate(TEXTS)}
