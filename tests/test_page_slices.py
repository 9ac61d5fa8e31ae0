"""Pages reach the HTML pass a few at a time, not as whole batches of Python objects."""

from packlens.sources import html_parts as H


def test_parts_of_more_pages_than_a_slice(spark):
    pages = [(i, None if i == 7 else f"<title>T{i}</title><li>Net Quantity: {i} g</li>", "https://x.example/") for i in range(2 * H.PAGES + 3)]
    parts = H.html_parts(spark.createDataFrame(pages, "page_id long, html string, url string").coalesce(1))
    assert "MapInArrow" in parts._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, parts.collect()), key=lambda r: r[:1] + r[2:3]) == [(i, *p) for i, h, u in pages for p in H.parts_of(h, u)]
    assert H.html_parts(spark.createDataFrame([], "page_id string, html string, url string")).collect() == []
