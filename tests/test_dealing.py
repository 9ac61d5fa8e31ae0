"""Small rows that take long are dealt out before the work on them; dates are tried by their separators."""

import pytest
from packlens.functions.text import normalize_date
from packlens.plans import audit, captures, registry
from packlens.plans.synth import listings
from pyspark.sql import functions as F

from tests.test_queries import SF


@pytest.mark.parametrize("make", [
    lambda s: audit.page_declarations(listings(s, SF)), lambda s: captures.listing_pages(listings(s, SF)), lambda s: captures.listing_boxes(listings(s, SF)),
    lambda s: registry.QUERIES["declaration_snippets"](s, SF), lambda s: registry.QUERIES["ocr_audit"](s, SF),
])
def test_work_does_not_wait_for_the_files_splits(spark, make):
    assert "REPARTITION_BY_COL" in make(spark)._jdf.queryExecution().executedPlan().toString()


def test_dates_of_every_form_and_of_none(spark):
    want = {
        "2024-05-01": "2024-05-01", "1/5/2024": "2024-05-01", "1-5-2024": "2024-05-01", "1.5.2024": "2024-05-01", "1 May 2024": "2024-05-01", "1 June 2024": "2024-06-01",
        "05/2024": "2024-05-01", "5-2024": "2024-05-01", " May  2024 ": "2024-05-01", "June 2024": "2024-06-01", "2024": None, "": None, "1/5-2024": None, "a-b": None,
    }
    rows = spark.createDataFrame([(k,) for k in want], "t string").select("t", normalize_date(F.col("t")).alias("d")).collect()
    assert {r["t"]: r["d"] for r in rows} == want
