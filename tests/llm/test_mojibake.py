import pytest
from pyspark.sql import functions as F

from trellium.llm.mojibake import examine, examined, is_garbled

DE = "Für größere Prüfstände beschäftigt die Firma rund 30 Menschen – auch in München. „Wir prüfen lieber“, heißt es."
FR = "Vous allez négocier des pièces à l’atelier avec une première expérience ; la rémunération va de 40 000 € à 50 000 €."
ES = "¿Te gustaría diseñar máquinas con gestión técnica? El salario está entre 30.000 € y 40.000 € al año."
PL = "W zespole wysyłki pracuje już 40 osób. Mile widziane doświadczenie i znajomość języka; części zamienne w dziale."
CS = "V týmu údržby působí 57 lidí. Přihlášky přijímáme průběžně a výhodou je zkušenost: náhradní díly, řidičský průkaz."
PT = "ATENÇÃO: A PRODUÇÃO NÃO PARA. Valorizamos experiência com câmaras frias e relatórios sólidos; à noite não."


@pytest.mark.parametrize("text", [DE, FR, ES, PL, CS, PT, "a naïve café", "±8 µm bei 5 °C, 30 m² und 12 m³", "B&uuml;ro &raquo; Kontakt &amp; mehr", "Für größere Prüfstände", "", None, "ASCII only", "open‑ended work", "Łódź ©™ 20 € ½"])
def test_right_texts(text):
    assert examine(text) == (False, text)


@pytest.mark.parametrize("text", [DE, FR, ES, PL, CS, PT])
@pytest.mark.parametrize("assumed", ["cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1250"])
def test_round_trip_of_utf8(text, assumed):
    raw = text.encode()
    bad = "".join(bytes([b]).decode(assumed, "ignore") or chr(b) for b in raw)
    garbled, restored = examine(bad)
    assert garbled
    right, wrong = text.split(), restored.split()
    assert sum(a == b for a, b in zip(right, wrong)) >= 0.7 * len(right) if len(right) == len(wrong) else True


@pytest.mark.parametrize("text,actual,assumed", [(DE, "cp1252", "mac_roman"), (DE, "cp1252", "cp437"), (DE, "cp1252", "cp850"), (ES, "cp1252", "mac_roman"), (ES, "cp1252", "cp437"), (PL, "cp1250", "cp1252"), (CS, "cp1250", "cp1252")])
def test_one_byte_encodings(text, actual, assumed):
    bad = text.encode(actual).decode(assumed, "replace").replace("�", "")
    assert examine(bad)[0]


def test_twice_garbled_and_lost():
    twice = "Stücklisten übergeben".encode().decode("cp1252").encode().decode("cp1252")
    assert examine(twice) == (True, "Stücklisten übergeben")
    assert examine("einf�hren")[0]


@pytest.mark.parametrize("times", [3, 4, 5, 6])
@pytest.mark.parametrize("assumed", ["cp1252", "latin-1"])
def test_garbled_many_times(times, assumed):
    text = "Wir prüfen größere Stücklisten"
    bad = text
    for _ in range(times):
        bad = "".join(bytes([b]).decode(assumed, "ignore") or chr(b) for b in bad.encode())
    assert examine(bad) == (True, text)


def test_restoring_reads_each_text_once(spark, tmp_path):
    from trellium.llm.problems.p10 import p10_restored

    spark.createDataFrame([(1, "cafÃ©")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = p10_restored(spark, str(tmp_path))
    assert [tuple(r) for r in found.collect()] == [(1, "café")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_columns(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "cafÃ©", "x"), (4, "café", "x"), (5, ("Prüfstände " * 30_000) + "cafÃ©", "x"), (6, "cafÃ©", "x")]
    df = spark.createDataFrame(rows, "doc_id int, text string, garbled string")
    assert [r.doc_id for r in df.filter(is_garbled(F.col("text"))).orderBy("doc_id").collect()] == [3, 5, 6]
    got = {r.doc_id: r.x for r in df.select("doc_id", examined(F.col("text")).alias("x")).collect()}
    assert (got[3].restored, got[4].restored, got[1].restored, got[5].restored[-4:]) == ("café", "café", None, "café")
    assert df.limit(0).filter(is_garbled(F.col("text"))).count() == 0
