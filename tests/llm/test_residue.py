import pytest
from pyspark.sql import functions as F

from trellium.llm.residue import is_residue, matcher

CASES = [
    "{{ position }} bei X GmbH", "Einkäufer (m/w/d) in *|metaTitle|*", "#STELLENTITEL#", "[Stellentitel einfügen]", "&lt;title&gt;", "%s – offene Stellen", "{0} Jobs in {1}", "404", "Firma X | 404", "Fehler 503", "FEHLER 500", "Request 6fee01 failed with 408", "Serverfehler (500), Vorgang 042b86",
    "Please enable JavaScript", "Active JavaScript para continuar", "Veuillez activer JavaScript – Firma X", "Lorem ipsum dolor sit amet", "Firma X: Seite nicht gefunden", "Stránka nenalezena", "null - null", "NaN Stellenangebote", "  Just a moment...  ", "test42", "i18n:career.headline", "[object Object]",
]
OTHERS = [
    "JavaScript Entwickler (m/w/d) | Firma X", "Controller – JavaScript", "404 offene Stellen bei Firma X", "500 Ausbildungsplätze Dorf", "404 Jobs in Dorf – Firma X", "Error Handling Engineer – Firma X", "Null-Fehler-Programm: Qualitätsprüfer (w/m/d)", "Lorem & Ipsum Druckhaus: Ausbildung", "[m/w/d] Einkäufer in Dorf",
    "Template Designer {all genders} in Dorf", "C#/.NET Entwickler & DevOps {all genders}", "<3 Jobs mit Herz bei X", "$ales Talent Program X", "Zeitarbeit? Just a call: X", "Access Manager (m/w/d) bei X", "Wartungstechniker (m/w/d) Dorf", "Stellenangebote Dorf – Seite 404", "100 % Homeoffice bei X", "Elektroniker * | X", "",
]


@pytest.mark.parametrize("title", CASES)
def test_residue(title):
    assert matcher(0.8).coverage(title) >= 0.8


@pytest.mark.parametrize("title", OTHERS)
def test_real_titles(title):
    assert matcher(0.8).coverage(title) < 0.8


def test_column_with_nulls_repeats_and_long_texts(spark):
    rows = [(None, 1), ("", 2), ("   ", 3), ("404", 4), ("404", 5), ("Einkäufer " * 30_000, 6), ("Fehler 404 " * 20_000, 7)]
    df = spark.createDataFrame(rows, "title string, coverage int")
    assert [r.coverage for r in df.filter(is_residue(F.col("title"))).orderBy("coverage").collect()] == [4, 5, 7]
    assert df.limit(0).filter(is_residue(F.col("title"))).count() == 0
