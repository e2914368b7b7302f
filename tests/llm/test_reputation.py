"""Host reputation where counts say little: no host is blocked for what its neighbours did."""

from pyspark.sql import Row

from arcweave.llm import url_filters


def judge(spark, outcomes, urls):
    pages = spark.createDataFrame([Row(page_id=i, url=u) for i, u in enumerate(urls)], "page_id long, url string")
    found = url_filters.filter_urls(pages, spark.createDataFrame(outcomes, "host string, bad int"), rules=[])
    return {urls[r["page_id"]]: r["verdict"] for r in found.collect()}


def test_one_page_a_host_blocks_nobody_known_to_be_good(spark):
    outcomes = [(f"bad{i}.com", 1) for i in range(120)] + [(f"good{i}.com", 0) for i in range(80)]
    urls = [f"http://good{i}.com/x" for i in range(80)] + [f"http://new{i}.com/" for i in range(20)] + [f"http://new{i}.org/" for i in range(20)] + [None, "no url"]
    assert set(judge(spark, outcomes, urls).values()) == {"allow"}


def test_one_label_in_all(spark):
    assert set(judge(spark, [("a.com", 1)], ["http://a.com/", "http://b.com/", "http://c.org/", None]).values()) == {"allow"}
    assert set(judge(spark, [], ["http://a.com/", None]).values()) == {"allow"}


def test_many_labels_speak_for_host_and_domain(spark):
    outcomes = [("evil.com", 1)] * 40 + [("fine.com", 0)] * 40 + [(f"h{i}.farm.net", 1) for i in range(30) for _ in range(5)] + [(f"ok{i}.net", 0) for i in range(30) for _ in range(5)] + [("", 1)] * 50
    found = judge(spark, outcomes, ["http://evil.com/", "http://fine.com/", "http://other.com/", "http://new.farm.net/", "http://h3.farm.net/", "http://ok3.net/", "http://www.ok3.net/", None])
    assert found == {"http://evil.com/": "block", "http://fine.com/": "allow", "http://other.com/": "allow", "http://new.farm.net/": "block", "http://h3.farm.net/": "block", "http://ok3.net/": "allow", "http://www.ok3.net/": "allow", None: "allow"}
