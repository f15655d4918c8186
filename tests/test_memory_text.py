from datetime import datetime

from trellium.plans import catalog

MEMORY = "source_key string, score double, visits bigint, jobs_found bigint, high_fit_jobs bigint, errors bigint, no_job_streak bigint, notes string"
JOBS = "job_id bigint, url string, title string, company string, location string, posting_language string, fit_score int, score_source string, score_basis string, reason string, evidence string, source_page string, source_key string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz"


def summary(spark, d, sources, jobs):
    spark.createDataFrame(sources, MEMORY).write.parquet(f"{d}/source_memory.parquet")
    spark.createDataFrame(jobs, JOBS).write.parquet(f"{d}/jobs.parquet")
    return tuple(catalog.queries()["memory_summary_full"](spark, str(d)).first())


def job(n, url, title, day, language="de", source="llm"):
    at = datetime(2025, 1, day) if day else None
    return (n, url, title, "C", "L", language, 70 + n, source, None, None, None, None, "k", at, at)


def test_memory_text_has_three_sections(spark, tmp_path):
    sources = [("a", 0.25, 3, 1, 0, 2, 1, None), ("b", 90.0, 4, 5, 2, 0, 0, "good"), ("c", 0.25, 1, 0, 0, 0, 5, ""), ("never", 99.0, 0, 0, 0, 0, 0, "")]
    jobs = [job(1, "u1", "old", 1), job(2, "u1", "new", 5, None, ""), job(3, "u2", "no time", None), job(4, "u3", "late", 9)]
    whole, line = summary(spark, tmp_path, sources, jobs)
    assert whole.split("\n") == [
        "Good sources:", "- b: score=90.0, jobs=5, high_fit=2, notes=good", "- a: score=0.2, jobs=1, high_fit=0, notes=", "- c: score=0.2, jobs=0, high_fit=0, notes=",
        "Weak sources:", "- c: score=0.2, no_job_streak=5, errors=0, notes=", "- a: score=0.2, no_job_streak=1, errors=2, notes=", "- b: score=90.0, no_job_streak=0, errors=0, notes=good",
        "Recent matched jobs:", "- 74 late at C (L; score_source=llm; language=de) from k", "- 72 new at C (L; score_source=unknown; language=unknown) from k", "- 73 no time at C (L; score_source=llm; language=de) from k",
    ]
    assert line == "b:score=90.0,visits=4,jobs=5,high_fit=2; a:score=0.2,visits=3,jobs=1,high_fit=0; c:score=0.2,visits=1,jobs=0,high_fit=0"


def test_memory_text_of_an_empty_memory(spark, tmp_path):
    assert summary(spark, tmp_path, [], []) == ("No source memory yet. Explore conservatively and prefer public career/job pages.", "no visited sources yet")


def test_each_section_has_eight_entries(spark, tmp_path):
    whole, _ = summary(spark, tmp_path, [(f"s{n}", float(n), 1, 0, 0, 0, 0, "") for n in range(20)], [job(n, f"u{n}", "t", 1 + n) for n in range(20)])
    assert whole.count("\n") == 3 * 9 - 1 and "- s19:" in whole and "- s0:" in whole and "- s10:" not in whole and "- 89 t" in whole
