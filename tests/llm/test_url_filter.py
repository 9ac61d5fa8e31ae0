from datetime import datetime

from packlens.llm import url_filter as U

D = lambda m, d: datetime(2024, m, d)


def test_entries_hold_from_add_to_remove(spark):
    entries = spark.createDataFrame(
        [("host", "a.x.org", "add", D(1, 1)), ("host", "a.x.org", "remove", D(2, 1)), ("domain", "y.org", "add", D(3, 1)), ("prefix", "b.z.org/p/q", "add", D(1, 1)),
         ("host", "t.org", "add", D(1, 1)), ("host", "t.org", "remove", D(1, 1)), (None, "n.org", "add", D(1, 1)), ("host", "a.x.org", "add", D(1, 1))],
        "kind string, pattern string, action string, at timestamp",
    )
    caps = spark.createDataFrame(
        [(1, "https://A.x.org/", D(1, 1), "h"), (2, "https://a.x.org/", D(2, 1), "h"), (3, "http://u@m.y.org:80/x", D(3, 2), "h"), (4, "http://m.y.org/x", D(2, 2), "h"), (5, "http://b.z.org/p/q/r?s", D(5, 1), "h"),
         (6, "http://b.z.org/p/qq", D(5, 1), "h"), (7, "http://t.org", D(1, 2), "h"), (8, None, D(1, 1), "h"), (9, "http://a.x.org", None, "h"), (None, "http://a.x.org", D(1, 5), "h"), (10, "no url", D(1, 1), "h"),
         (1, "https://A.x.org/", D(1, 1), "h")],
        "page_id long, url string, fetched_at timestamp, host string",
    )
    rows = U.filter_urls(caps, entries).collect()
    assert len(rows) == 12
    assert sorted(str(r.page_id) for r in rows if r.blocked) == ["1", "1", "3", "5", "None"]
    assert {r.first_pattern for r in rows if r.page_id == 3} == {"domain:y.org"}
    assert U.filter_urls(caps.limit(0), entries).count() == 0 and not any(r.blocked for r in U.filter_urls(caps, entries.limit(0)).collect())
