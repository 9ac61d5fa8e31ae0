from packlens.functions import patterns, text as X
from packlens.functions.fuzzy import fuzzy_date, ratio
from pyspark.sql import functions as F


def col(spark, fn, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def found(spark, t):
    rows = col(spark, patterns.candidates, t)[0]
    out = {}
    for r in rows:
        out.setdefault(r.field_name, []).append(r.field_value)
    return out


def test_values(spark):
    assert col(spark, X.normalize_currency, "Rs. 1,234.5", "60", "none", None, "₹193/100g") == ["1234.50", "60.00", None, None, "193.00"]
    assert col(spark, X.normalize_quantity, "0.1 kg", "100 g", "1 Litre", "500 ग्राम", "५०० ग्राम", "12 pcs", "x", "1.5 kg") == ["100g", "100g", "1000ml", "500g", "500g", None, None, "1500g"]
    assert col(spark, X.normalize_text, " a \t b ", None) == ["a b", None]
    assert col(spark, X.normalize_date, "05/2024", "1/2/2024", "2024-12-31", "3 Mar 2024", "soon", "") == ["2024-05-01", "2024-02-01", "2024-12-31", "2024-03-03", None, None]
    assert col(spark, X.looks_like_date, "Jan 2024", "12/25", "tomorrow", None) == [True, True, False, False]


def test_fuzzy(spark):
    assert ratio("Acme Foods Ltd", "Ltd Foods Acme") == 100 and ratio("", "") == 100 and ratio(None, "x") is None
    assert round(ratio("abc", "abd"), 3) == 66.667
    assert col(spark, fuzzy_date("2024-06-15"), "packed 5 March", "??", None) == ["2024-03-05", None, None]


def test_english_patterns(spark):
    f = found(spark, "Mfg. & Mktg. by: Acme Foods Ltd, P.O. Box 1, Sector 9, Gurgaon 122002, Haryana | MRP: Rs. 60.00 (incl of all taxes) | Net Content: 500 ml")
    assert f["manufacturer_name"] == ["Acme Foods Ltd"] and f["manufacturer_address"][0].endswith("122002") and f["mrp"] == ["60.00"] and f["net_quantity"] == ["500 ml"]
    f = found(spark, "M.R.P. ₹ 45 | Country of Origin: Sri Lanka | Consumer Care: care@x.org | Toll Free: 1800 123 4567 | Best Before: 12/2025")
    assert f["mrp"] == ["45"] and f["country_of_origin"] == ["Sri Lanka"] and f["consumer_care_email"] == ["care@x.org"] and f["consumer_care_name"] == ["care@x.org"]
    assert f["consumer_care_phone"] == ["1800 123 4567"] and f["best_before_date"] == ["12/2025"]


def test_things_that_are_no_declarations(spark):
    assert found(spark, "Manufacturer info | ₹193/100g | Protein: 2 g | Similar chips 125 g") == {}
    f = found(spark, "MFD.BY: LIC. No.: 1013022002253")
    assert "manufacturer_name" not in f


def test_hindi_patterns(spark):
    f = found(spark, "अधिकतम खुदरा मूल्य: Rs. 150.00 | शुद्ध मात्रा: 500 ग्राम | निर्माता: एक्मे फूड्स | मूल देश: भारत | आयातक - ग्लोबल")
    assert f["mrp"] == ["150.00"] and f["net_quantity"] == ["500 ग्राम"] and f["manufacturer_name"] == ["एक्मे फूड्स"] and f["country_of_origin"] == ["भारत"] and f["importer_name"] == ["ग्लोबल"]
    assert "net_quantity" not in found(spark, "शुद्ध मात्रा: 2 किलो x")
