import pytest
from packlens.operators import classify, context, declare, rules
from packlens.functions.vocab import NA, NMR, PASS, PNC, UTV
from packlens.plans import audit, captures
from packlens.plans.synth import listings
from pyspark.sql import functions as F

DECL = "inspection_id string, field_name string, field_value string, source_type string, confidence double, ord int"


def run(spark, decl, page=("SUCCESS",), images=0, ocr=None, category="FOOD", text=""):
    d = declare.normalized(spark.createDataFrame([("i", f, v, s, c, n) for n, (f, v, s, c) in enumerate(decl)], DECL))
    ins = spark.createDataFrame([("i", category, text)], "inspection_id string, category string, listing_text string")
    pages = spark.createDataFrame([("i", True, False, page[0] == "SUCCESS")] if page else [], "inspection_id string, has_page_row boolean, hollow boolean, usable_page boolean")
    imgs = spark.createDataFrame([("i", images, ocr)] if images else [], "inspection_id string, n_images long, ocr_conf double")
    out = rules.evaluate(context.build_context(ins, d, pages, imgs)).collect()
    return {r.rule_key: r for r in out}


def web(f, v, c=0.8):
    return (f, v, "WEBPAGE_TEXT", c)


def ocr(f, v, c=0.9):
    return (f, v, "IMAGE_OCR", c)


def test_price_rule_has_five_outcomes(spark):
    got = run(spark, [web("mrp", "60.00"), web("net_quantity", "100 g")], images=1, ocr=0.9)
    assert len(got) == 23 and got["R6-1E-MRP"].status == PASS and got["R6-1E-MRP"].confidence == 0.8
    assert run(spark, [web("net_quantity", "100 g")], images=1, ocr=0.9)["R6-1E-MRP"].status == PNC
    weak = run(spark, [ocr("net_quantity", "100 g")], page=None, images=1, ocr=0.2)["R6-1E-MRP"]
    assert weak.status == NMR
    none = run(spark, [], page=None)["R6-1E-MRP"]
    assert (none.status, none.confidence) == (UTV, 0.3)
    assert run(spark, [web("mrp", "on request")], images=1, ocr=0.9)["R6-1E-MRP"].status == PNC


@pytest.mark.parametrize(
    ("qty", "text", "status"),
    [("5 g", "", NA), ("5 g", "tobacco tin", PNC), ("30 kg", "", PNC), ("30 l", "", NA), ("51 kg", "", NA), ("100 g", "for industrial use", NA), ("100 g", "", PNC)],
)
def test_quantity_gates(spark, qty, text, status):
    got = run(spark, [web("net_quantity", qty)], images=1, ocr=0.9, text=text)
    assert got["R6-1E-MRP"].status == status and got["R6-1C-NET-QUANTITY"].status == PASS


def test_category_gate(spark):
    assert run(spark, [], category="HOUSEHOLD")["R6-1DA-BEST-BEFORE"].status == NA
    assert run(spark, [], category="FOOD")["R6-1A-MFR-NAME"].status == NA
    got = run(spark, [web("manufacturer_name", "A"), web("manufacturer_address", "Plot One, Pune 411001", 0.55)], category="HOUSEHOLD")
    assert (got["R6-1A-MFR-NAME"].status, got["R6-1A-MFR-NAME"].confidence) == (PASS, 0.55) and got["R10-NAME-ADDR-FORM"].status == PASS


def test_origin(spark):
    assert run(spark, [web("importer_name", "G")])["R6-1AA-COUNTRY-ORIGIN"].status == PNC
    assert run(spark, [web("importer_name", "G"), web("country_of_origin", "Nepal")])["R6-1AA-COUNTRY-ORIGIN"].status == PASS
    assert run(spark, [web("manufacturer_name", "G")])["R6-1AA-COUNTRY-ORIGIN"].status == NA
    assert run(spark, [])["R6-1AA-COUNTRY-ORIGIN"].status == UTV


def test_consistency(spark):
    both = lambda f, a, b: run(spark, [web(f, a), ocr(f, b)], images=1, ocr=0.9)
    assert both("mrp", "60", "60.00")["CONSISTENCY-MRP"].status == PASS
    assert both("mrp", "60", "75")["CONSISTENCY-MRP"].status == PNC
    assert both("net_quantity", "0.1 kg", "100 g")["CONSISTENCY-NET-QUANTITY"].status == PASS
    assert both("product_name", "Acme Potato Chips", "Chips Potato Acme")["CONSISTENCY-PRODUCT-NAME"].status == PASS
    assert both("manufacturer_name", "Acme Foods", "Zenith Mills")["CONSISTENCY-MANUFACTURER"].status == PNC
    assert run(spark, [web("mrp", "60")])["CONSISTENCY-MRP"].status == UTV


def test_manual_hint_and_unit_price_rules(spark):
    got = run(spark, [web("product_name", "Cough syrup tablets from a restaurant"), web("mrp", "60.00"), web("unit_sale_price", "60"), web("net_quantity", "100 g when packed")], text="pack of 6")
    assert got["R26-EXEMPT-DRUG-FORMULATIONS"].status == NMR and got["R26-EXEMPT-THREAD-COIL"].status == NA and got["R26-EXEMPT-FAST-FOOD"].status == NMR
    assert got["R6-11-UNIT-SALE-PRICE"].status == PASS and got["R11-QTY-BASIS"].status == PNC and got["R31-ADVERTISEMENT-NET-QTY"].status == NMR
    assert run(spark, [web("mrp", "60.00")], text="pack of 6", images=1, ocr=0.9)["R6-11-UNIT-SALE-PRICE"].status == PNC


def test_consumer_care_and_display(spark):
    four = [web(f"consumer_care_{x}", "v") for x in ("name", "address", "phone", "email")]
    got = run(spark, [*four, web("product_name", "n"), web("net_quantity", "100 g"), web("mrp", "1"), web("packer_name", "p")])
    assert got["R6-2-CONSUMER-CARE"].status == PASS and got["R6-10-ECOMMERCE-DISPLAY"].status == PASS
    assert run(spark, [ocr("mrp", "1")], page=None, images=1, ocr=0.9)["R6-10-ECOMMERCE-DISPLAY"].status == NA


def test_unknown_handler_and_number_rule(spark):
    odd = (rules.Rule("X-1", "nobody", "MINOR", "t"), rules.Rule("X-2", "number", "MINOR", "t", fields=("mrp",), low=1.0, high=50.0))
    d = declare.normalized(spark.createDataFrame([("i", "mrp", "60", "WEBPAGE_TEXT", 0.8, 0)], DECL))
    ins = spark.createDataFrame([("i", "FOOD", "")], "inspection_id string, category string, listing_text string")
    pages = spark.createDataFrame([("i", True, False, True)], "inspection_id string, has_page_row boolean, hollow boolean, usable_page boolean")
    imgs = spark.createDataFrame([], "inspection_id string, n_images long, ocr_conf double")
    got = {r.rule_key: r for r in rules.evaluate(context.build_context(ins, d, pages, imgs), odd).collect()}
    assert (got["X-1"].status, got["X-1"].confidence) == (UTV, 0.0) and got["X-2"].status == PNC


def test_overall_status(spark):
    c = spark.createDataFrame([("a", PASS), ("a", PNC), ("b", NA), ("c", PASS), ("c", NA)], "inspection_id string, status string")
    assert {r.inspection_id: r.overall_status for r in rules.overall_status(c).collect()} == {"a": PNC, "b": UTV, "c": PASS}


def test_dedup_keeps_the_best_and_the_different(spark):
    d = declare.normalized(spark.createDataFrame([("i", "mrp", "Rs. 60.00", "WEBPAGE_TEXT", 0.7, 0), ("i", "mrp", "60.00", "STRUCTURED_METADATA", 0.9, 1), ("i", "mrp", "99", "WEBPAGE_TEXT", 0.5, 2)], DECL))
    rows = declare.dedup_candidates(d, ["inspection_id"]).collect()
    assert sorted((r.normalized_value, r.confidence) for r in rows) == [("60.00", 0.9), ("99.00", 0.5)]


def test_classification(spark):
    df = spark.createDataFrame([(0, "Namkeen chips"), (1, "herbal shampoo"), (2, "floor cleaner"), (3, ""), (4, "thing"), (5, None), (6, "chipset")], "i int, t string")
    got = [r.c for r in df.select("i", classify.classify(F.col("t")).alias("c")).orderBy("i").collect()]
    assert [g.category for g in got] == ["FOOD", "COSMETIC_PERSONAL_CARE", "HOUSEHOLD", "UNKNOWN", "UNKNOWN", "UNKNOWN", "UNKNOWN"]
    assert [g.confidence for g in got][2:6] == [0.75, 0.0, 0.1, 0.0] and list(got[0].matched) == ["chips", "namkeen", "namkeen"]


def test_rules_come_back_from_a_stored_set(spark, tmp_path):
    rules.rule_frame(spark).write.json(str(tmp_path / "rules"))
    got = rules.rules_from(rules.read_rules(spark, str(tmp_path / "rules")))
    assert got == tuple(sorted(rules.SEEDED, key=lambda r: r.rule_key))
    assert rules.rules_from(rules.rule_frame(spark).limit(0)) == ()


def test_history_of_loads_and_as_of(spark):
    """Changed content, a gap with the same content, a gap with other content, and the versions on given days."""
    from packlens.operators import report, versioning

    loads = {1: {"A": "x", "B": "p"}, 2: {"A": "y", "B": "p"}, 3: {"A": "y"}, 4: {"A": "y", "B": "p"}, 5: {"B": "q"}}
    rows = [(k, day, h, f"Doc {h}", f"Ref {k}", "loc") for day, rules in loads.items() for k, h in rules.items()]
    frame = spark.createDataFrame(rows, "rule_key string, loaded_at int, content_hash string, source_document string, rule_reference string, source_locator string")
    h = versioning.history(frame)
    got = sorted(tuple(r) for r in h.select("rule_key", "version_number", "valid_from", "valid_until").collect())
    assert [tuple(-1 if x is None else x for x in r) for r in sorted(got, key=lambda r: (r[0], r[2]))] == [("A", 1, 1, 2), ("A", 2, 2, 5), ("B", 1, 1, 3), ("B", 1, 4, 5), ("B", 2, 5, -1)]
    used = spark.createDataFrame([("i", k, d) for d in (3,) for k in ("A", "B")] + [("j", "A", 1), ("j", "B", 1), ("k", "B", 9), ("l", "A", 0)], "inspection_id string, rule_key string, day int")
    found = versioning.as_of(used, h, "day")
    assert sorted((r.inspection_id, r.rule_key, r.version_number) for r in found.collect()) == [("i", "A", 2), ("j", "A", 1), ("j", "B", 1), ("k", "B", 2)]
    (snap,) = [r.snapshot for r in report.versioned_snapshot(found).filter("inspection_id = 'j'").collect()]
    assert snap == (
        '{"rules":[{"rule_key":"A","version_number":1,"rule_reference":"Ref A","source_document":"Doc x","source_index":1,"source_locator":"loc"},'
        '{"rule_key":"B","version_number":1,"rule_reference":"Ref B","source_document":"Doc p","source_index":2,"source_locator":"loc"}]}'
    )


def test_ocr_hint_in_the_reason(spark):
    ins = spark.createDataFrame([("a", "u", "t", "FOOD")], "inspection_id string, url string, listing_text string, category string")
    none = spark.createDataFrame([], "inspection_id string, field_name string, field_value string, normalized_value string, source_type string, confidence double, ord int")
    pages = spark.createDataFrame([], "inspection_id string, has_page_row boolean, fetched boolean")
    imgs = spark.createDataFrame([("a", 1, 0.62)], "inspection_id string, n_images long, ocr_conf double")
    manner = [r for r in rules.SEEDED if r.rule_key == "R9-MANNER"]
    (r,) = rules.evaluate(context.build_context(ins, none, pages, imgs), tuple(manner)).collect()
    assert r.status == "NEEDS_MANUAL_REVIEW" and "62%" in r.reason


def test_dates_in_other_words_reach_the_checks(spark):
    """With the day that lends missing parts, the jobs over texts and over HTML read them; without it, such dates stay null."""
    lst = listings(spark, "/root/testdata/sf0.001").filter("k IN (5, 11)").withColumn("mfg_text", F.lit("12th of March 2024"))
    for job in (audit.declarations, captures.all_declarations):
        for as_of, want in ((None, {None}), ("2024-06-15", {"2024-03-12"})):
            assert {r.normalized_value for r in job(lst, as_of).filter("field_name = 'mfg_date'").collect()} == want, (job, as_of)
