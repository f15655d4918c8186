from trellium.plans import catalog
from trellium.plans.urls import _best_links

LINKS = "page_id int, page_url string, pos int, href string, text string"


def rows(spark, n):
    return spark.createDataFrame([(1, "https://a.test/", i, f"https://b{i}.test/careers/jobs/{i}", "Jobs") for i in range(n)], LINKS)


def test_best_links_keep_k_of_each_page(spark):
    for k in (1, 3, 80):
        assert sorted(r["rank"] for r in _best_links(rows(spark, 90), k).collect()) == list(range(1, k + 1))


def test_third_link_of_a_page_is_kept(spark, tmp_path):
    page = [(1, *[f"https://{h}.test/careers/jobs/1" for h in "abc"], "Jobs")]
    spark.createDataFrame(page, "page_id int, url string, final_url string, discovered_from string, title string").write.parquet(f"{tmp_path}/pages.parquet")
    assert catalog.queries()["link_rank_top80"](spark, str(tmp_path)).count() == 3
