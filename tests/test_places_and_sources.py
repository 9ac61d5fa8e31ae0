"""Places in huge groups, nested documents, located matches, dates in two tiers, and database tables in parts."""

import random

import pytest
from packlens.functions import fuzzy, patterns, text
from packlens.operators import declare, intake, places, report
from packlens.sources import readers
from pyspark.sql import functions as F


def test_places_of_a_batch_with_most_rows(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 7).alias("b"), (F.col("id") % 3).alias("s"), "id")
    rows = rows.withColumn("b", F.when(F.col("id") % 10 == 1, None).otherwise(F.coalesce("b", F.lit(1))))
    order = [F.desc("s"), F.col("id")]
    got = {r["id"]: r["place"] for r in places.placed(rows, "b", order).collect()}
    groups = {}
    for r in rows.collect():
        groups.setdefault(r["b"], []).append((-r["s"], r["id"]))
    want = {i: n for g in groups.values() for n, (_, i) in enumerate(sorted(g), 1)}
    assert got == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these few bytes would be put together
    try:
        parts = places.ranges(rows, "b", order).filter("b = 1").groupBy("_part").count().collect()
        again = {r["id"]: r["place"] for r in places.placed(rows, "b", order).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert again == want
    assert len(parts) >= 3 and max(r["count"] for r in parts) < 9_000  # of some 16,300


def test_places_of_nothing(spark):
    assert places.placed(spark.createDataFrame([], "b string, id bigint"), "b", [F.col("id")]).collect() == []


def test_only_accepted_urls_are_ranked(spark):
    urls = [("b", i, f"https://x.example/{i % 70}") for i in range(300)] + [("b", 300, "http:/"), ("b", 301, None), (None, 0, "https://y.example/1")]
    u = spark.createDataFrame(urls, "batch_id string, pos int, url string")
    df = intake.accept_urls(u)
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()
    got = {(r["batch_id"], r["pos"]): r["decision"] for r in df.collect()}
    for _, pos, url in urls[:300]:
        n = int(url.rsplit("/", 1)[1])
        assert got["b", pos] == ("over limit" if n >= 50 else "accepted" if pos == n else "duplicate")
    assert got["b", 300] == got["b", 301] == "too short"


def test_nested_documents(spark):
    parents = spark.createDataFrame([(1, "a"), (2, None), (None, "x")], "inspection_id int, url string")
    kids = spark.createDataFrame([(1, 2, "q"), (1, 1, None), (1, 1, None), (3, 9, "lost"), (None, 1, "lost")], "inspection_id int, n int, t string")
    got = {r["inspection_id"]: r for r in report.nested_documents(parents, kids=kids, none=kids.filter("n > 100")).collect()}
    assert sorted(got) == [1, 2] and got[2]["url"] is None and got[2]["kids"] == []
    assert [tuple(k) for k in got[1]["kids"]] == [(1, None), (1, None), (2, "q")] and got[1]["none"] == []
    assert report.nested_documents(parents.limit(0), kids=kids).collect() == []


def test_running_sums(spark):
    random.seed(3)
    arrays = [[random.randint(0, 9) for _ in range(n)] for n in (0, 1, 63, 64, 65, 128, 1000)]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i int, a array<int>")
    for r in df.select("a", text.running(F.col("a")).alias("s")).collect():
        assert r["s"] == [sum(r["a"][:i]) for i in range(len(r["a"]))]


TEXTS = [
    "Item 😀 | MRP: Rs. 5.50 | शुद्ध मात्रा: 5 ग्राम | Manufactured by: Tall Oaks Pvt, Plot 5 Pune 411001 | Packed by: Lic. No. 123456, x 400001 | MRP: Rs 7 MRP 8 a@b.co MRP Rs 9",
    "MRP 5 " * 500 + "😀", "", None, "nothing here", "Imported by:   , 400001 Country of Origin: Nepal",
]


def test_located_matches(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    plain = df.select("i", F.inline(patterns.candidates(F.col("t")))).collect()
    found = df.select("i", F.inline(patterns.located(F.col("t")))).collect()
    assert [tuple(r)[:5] for r in found] == [tuple(r) for r in plain] and len(found) > 500
    for r in found:
        t, ahead = TEXTS[r["i"]], 220 if r["field_name"].endswith("_address") else 20
        assert r["snippet"] == t[max(0, r["start_at"] - 20) : r["end_at"] + ahead].strip()
        assert ahead == 220 or r["field_value"] in t[r["start_at"] : r["end_at"]]
    assert not [r for r in found if r["field_name"].startswith("packer")]


def test_dates_in_two_tiers(spark):
    rows = [("1/2/2024", "2024-02-01"), ("made on the 3rd of January, 1995", "1995-01-03"), ("5 June", "2021-06-05"), ("best when fresh", None), ("", None), (None, None)]
    df = spark.createDataFrame([(v, w, "mfg_date") for v, w in rows] * 2, "v string, want string, _date string")
    got = fuzzy.with_dates(df.withColumnRenamed("_date", "f"), "v", "iso", "2021-03-04")
    assert got.count() == 12 and got.filter("NOT iso <=> want").count() == 0 and got.columns == ["v", "want", "f", "iso"]
    assert fuzzy.with_dates(df.limit(0).drop("_date"), "v", "iso", "2021-03-04").collect() == []


def test_declared_dates_of_other_forms(spark):
    d = spark.createDataFrame([("mfg_date", "the 3rd of January, 1995"), ("product_name", "3rd of January, 1995 tea")], "field_name string, field_value string")
    got = {r["field_name"]: r["normalized_value"] for r in declare.normalized(d, "2024-01-01").collect()}
    assert got == {"mfg_date": "1995-01-03", "product_name": "3rd of January, 1995 tea"}
    assert declare.normalized(d).filter("field_name = 'mfg_date'").first()["normalized_value"] is None


@pytest.fixture(scope="module")
def database(spark, tmp_path_factory):
    """A database in the driver's and local executors' own process."""
    url = f"jdbc:derby:directory:{tmp_path_factory.mktemp('db')}/d;create=true"
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    orders = orders.withColumn("k", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderkey")))
    orders.coalesce(1).write.jdbc(url, "orders")
    orders.limit(0).write.jdbc(url, "nothing")
    orders.limit(1).write.jdbc(url, "one")
    return url, orders


def test_database_table_in_parts(spark, database):
    url, orders = database
    lo, hi, n = readers.jdbc_bounds(spark, url, "orders", '"k"')
    assert n == orders.count() and lo == orders.agg(F.min("k")).first()[0] and hi == orders.agg(F.max("k")).first()[0]
    back = readers.jdbc_table(spark, url, "orders", '"k"', rows=-(-n // 8))
    assert back.rdd.getNumPartitions() == 8
    back = back.toDF(*orders.columns)
    assert back.exceptAll(orders).count() == 0 and orders.exceptAll(back).count() == 0 and back.filter("k IS NULL").count() > 0
    sizes = [r["count"] for r in back.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < n / 2
    assert readers.jdbc_table(spark, url, "orders", '"k"', rows=1, most=5).rdd.getNumPartitions() == 5


def test_small_database_tables(spark, database):
    url, _ = database
    assert readers.jdbc_table(spark, url, "nothing", '"k"').collect() == []
    assert readers.jdbc_table(spark, url, "one", '"o_orderkey"', rows=1).count() == 1
