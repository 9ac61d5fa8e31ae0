"""The stored audit: captures in any order, deliveries, restarts and user entries end as one batch job does."""

import pytest
from pyspark.sql import functions as F

from packlens.operators import declare
from packlens.plans import audit, captures
from packlens.plans.synth import listings
from packlens.streaming import ledger
from packlens.streaming.ledger import Ledger, Table

SF = "/root/testdata/sf0.001"
COLS = ["inspection_id", "rule_key", "status", "confidence", "reason"]


def stamped(df, day):
    return df.withColumn("fetched_at", F.timestamp_seconds(F.lit(day * 86_400) + F.col("k")))


@pytest.fixture(scope="module")
def new(spark):
    df = stamped(listings(spark, SF).filter("k <= 60"), 30)
    return spark.createDataFrame(df.collect(), df.schema)


def rows(df, cols=COLS):
    return sorted(map(str, df.select(*cols).collect()))


def test_a_killed_batch_is_applied_once(spark, new, tmp_path, monkeypatch):
    """Three waves; the second dies after its declarations are written, and the query starts again from its checkpoint.
    Late older captures and a second delivery of the newest change nothing."""
    old = stamped(new.withColumns({"qty_text": F.lit("7 kg"), "title": F.lit("Stale"), "mrp_text": F.lit(None).cast("string")}), 10)
    late = stamped(old, 20).filter("k % 2 = 0")
    source, job = str(tmp_path / "in"), captures.incremental(spark, str(tmp_path / "state"), new.schema)
    go = lambda: job.start(source, str(tmp_path / "cp")).awaitTermination()
    old.coalesce(1).write.mode("append").parquet(source)
    go()
    first = rows(job.current("checks"))
    new.filter("k % 2 = 0").coalesce(1).write.mode("append").parquet(source)
    with monkeypatch.context() as m:
        m.setattr(job, "judge", lambda *_: (_ for _ in ()).throw(RuntimeError("executor gone")))
        with pytest.raises(Exception, match="executor gone"):
            go()
    assert rows(job.current("checks")) == first  # nothing of a batch that isn't done is seen
    new.filter("k % 2 = 1").unionByName(late).unionByName(new.filter("k % 4 = 0")).coalesce(1).write.mode("append").parquet(source)
    go()
    assert rows(job.current("checks")) == rows(captures.checks(new))
    assert job.current("captures").count() == new.count() and job.current("captures").filter("title = 'Stale'").isEmpty()
    titles = {r.title for r in job.current("products").collect()}
    assert titles == {r.title for r in new.select("title").distinct().collect()}
    before = rows(job.current("checks"))
    job.apply(old, job._name(str(tmp_path / "cp")), 0)  # a batch that is done is left alone, whatever it brings
    job.ledger.compact()
    assert rows(job.current("checks")) == before and len(job.ledger._visible()) == 1


def test_user_entries_stay(spark, new, tmp_path):
    job = captures.incremental(spark, str(tmp_path / "state"), new.schema)
    some = new.filter("k <= 8")
    job.apply(some, "q", 0)
    said = spark.createDataFrame([("i7", "mrp", "Rs. 5.00"), ("i7", "net_quantity", "3 kg")], "inspection_id string, field_name string, field_value string")
    job.enter(said, "user", 0)
    job.enter(said.filter("field_name = 'mrp'").withColumn("field_value", F.lit("Rs. 6.00")), "user", 1)
    job.apply(stamped(some, 40), "q", 1)
    entered = job.current("declarations").filter("source_type = 'USER_INPUT'").select("inspection_id", "field_name", "field_value").collect()
    assert sorted(map(tuple, entered)) == [("i7", "mrp", "Rs. 6.00"), ("i7", "net_quantity", "3 kg")]
    mrp = job.current("checks").filter("inspection_id = 'i7' AND rule_key = 'R6-1E-MRP'").collect()
    assert [(r.status, r.confidence) for r in mrp] == [("PASS", 1.0)]


def test_ledger_shows_done_batches_only(spark, tmp_path):
    df = lambda *r: spark.createDataFrame(list(r), "k string, v int")
    led = Ledger(spark, str(tmp_path), {"t": Table(df(("a", 1)).schema, "k")})
    assert led.current("t").count() == 0 and led.begin("q", 0) == 1
    led.put("t", 1, df(("a", 1), ("a", 2), ("b", 3)))
    assert led.current("t").count() == 0 and led.begin("q", 0) == 1  # begun, not done: the same seq again
    led.done("q", 0, 1)
    assert led.begin("q", 0) is None
    assert led.begin("q", 1) == 2 and led.begin("other", 0) == 3  # two queries never share a seq
    led.put("t", 2, df(("a", 9), (None, 4)))
    led.done("q", 1, 2)
    assert sorted(map(str, led.current("t").collect())) == sorted(map(str, df(("a", 9), ("b", 3), (None, 4)).collect()))
    assert led.current("t", df(("b", 0)).select("k")).count() == 1
    led.compact()
    assert led.current("t").count() == 3 and len(led._visible()) == 1


@pytest.mark.parametrize("derive", [audit.declarations, captures.all_declarations])
def test_a_large_batch_is_merged_not_broadcast(spark, new, tmp_path, monkeypatch, derive):
    """Small files may hold many rows: whatever Spark takes them for, only the vocabulary of labels goes through the driver."""
    planned, put = [], Ledger.put
    monkeypatch.setattr(Ledger, "put", lambda self, name, seq, rows: (planned.append(rows._jdf.queryExecution().executedPlan().toString()), put(self, name, seq, rows)))
    monkeypatch.setattr(ledger, "FEW_KEYS", 0, raising=False)
    job = captures.incremental(spark, str(tmp_path / "state"), new.schema, derive)
    job.apply(stamped(new, 10), "q", 0)
    job.apply(stamped(new, 20), "q", 1)
    job.enter(spark.createDataFrame([("i7", "mrp", "Rs. 5.00")], "inspection_id string, field_name string, field_value string"), "user", 0)
    job.ledger.compact()
    joins = [line for p in planned for line in p.splitlines() if "Join" in line]
    assert len(planned) == 16 and len(joins) > 20 and [j for j in joins if "Broadcast" in j and "label_key" not in j] == []
    monkeypatch.setattr(ledger, "FEW_KEYS", 1)
    few = job.ledger.current("captures", new.filter("k = 7").select("inspection_id"))  # the log stays where it is
    assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString() and few.count() == 1


def test_a_rerun_derives_once_and_keeps_user_entries(spark):
    """Inspections that are not in new keep all; rows without a key match nothing."""
    kind = "inspection_id string, field_value string, source_type string"
    old = spark.createDataFrame([("a", "1", "IMAGE_OCR"), ("a", "2", "USER_INPUT"), ("a", "3", None), ("b", "4", "IMAGE_OCR"), (None, "5", "IMAGE_OCR")], kind)
    new = spark.range(2).select(F.lit("a").alias("inspection_id"), F.lit("6").alias("field_value"), F.lit("IMAGE_OCR").alias("source_type"))
    out = declare.replace_derived(old, new.unionByName(spark.createDataFrame([(None, "7", "IMAGE_OCR")], kind)))
    assert out._jdf.queryExecution().executedPlan().toString().count("Range (0, 2") == 1
    assert sorted(r.field_value for r in out.collect()) == ["2", "4", "5", "6", "6", "7"]
