"""Rules on inspections that take each branch of them, and how reports call the outcomes.

A part is one of CASES by its key; a case says what its page and image declare. The oracle states every outcome in
words of its own: what an inspection without further declarations gets, and what each case changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packlens.functions.vocab import NA, NMR, PASS, PNC, UTV
from packlens.operators import context, declare, report, rules
from packlens.session import table

QUERIES, ORACLES = {}, {}

#: Beside the seeded rules one of a number's range and one whose handler nobody knows.
RULES = (*rules.SEEDED, rules.Rule("X-RANGE", "number", "MINOR", "Quantity in range", fields=("net_quantity",), low=1.0, high=600.0), rules.Rule("X-ODD", "odd", "MINOR", "Unknown handler"))

_CARE = {"consumer_care_name": "Help Desk", "consumer_care_address": "Plot One, Pune 411001", "consumer_care_phone": "1800-123-4567", "consumer_care_email": "care@shop.example"}

#: (page declarations, image declarations, listing text): added to or in place of a name and 500 g.
CASES = (
    ({}, {}, ""),
    ({"net_quantity": "60 kg"}, {}, ""),
    ({"net_quantity": "30 l"}, {}, ""),
    ({"net_quantity": "30 kg"}, {}, ""),
    ({}, {}, "catering pack"),
    (_CARE, {}, ""),
    ({"product_name": "Restaurant style rice"}, {}, ""),
    ({"product_name": "Cough syrup"}, {}, ""),
    ({"product_name": "Handloom yarn"}, {}, ""),
    ({"net_quantity": "500 g when packed"}, {}, ""),
    ({}, {}, "Pack of 6"),
    ({"manufacturer_name": "Acme Foods Private Limited"}, {"manufacturer_name": "Private Limited Acme Foods"}, ""),
    ({"manufacturer_name": "Acme Foods"}, {"manufacturer_name": "Zenith Mills"}, ""),
    ({"product_name": "Golden leaf tea"}, {"product_name": "Golden leaf teas"}, ""),
    ({"importer_name": "Global Goods", "country_of_origin": "Nepal"}, {"importer_name": "Harbour Traders", "country_of_origin": "Nepal"}, ""),
    ({"net_quantity": "900 g"}, {}, ""),
    ({"manufacturer_address": "Somewhere far away"}, {}, ""),
    ({"manufacturer_address": "Plot One, Pune 411001"}, {}, ""),
    ({"net_quantity": "8 g"}, {}, ""),
    ({"net_quantity": "8 g"}, {}, "tobacco tin"),
    ({"mrp": "Rs. 60.00", "unit_sale_price": "60.00"}, {"mrp": "Rs. 61.00"}, ""),
    ({"mfg_date": "05/2024"}, {}, ""),
    ({"mfg_date": "soon"}, {}, ""),
    ({"mfg_date": "the 12th day of March of 2024"}, {}, ""),
)

#: What a name and 500 g on a page with one readable image get.
PLAIN = {
    "R6-1A-MFR-NAME": PNC, "R6-1AA-COUNTRY-ORIGIN": UTV, "R6-1B-GENERIC-NAME": PASS, "R6-1C-NET-QUANTITY": PASS, "R6-1D-MFG-DATE": NMR, "R6-1DA-BEST-BEFORE": NA,
    "R6-1E-MRP": PNC, "R6-2-CONSUMER-CARE": PNC, "R6-10-ECOMMERCE-DISPLAY": PNC, "R6-11-UNIT-SALE-PRICE": NMR, "R9-MANNER": NMR, "R10-NAME-ADDR-FORM": PNC,
    "R11-QTY-BASIS": PASS, "R31-ADVERTISEMENT-NET-QTY": NA, "R26-EXEMPT-FAST-FOOD": NA, "R26-EXEMPT-DRUG-FORMULATIONS": NA, "R26-EXEMPT-THREAD-COIL": NA,
    "CONSISTENCY-MRP": UTV, "CONSISTENCY-NET-QUANTITY": UTV, "CONSISTENCY-PRODUCT-NAME": UTV, "CONSISTENCY-MANUFACTURER": UTV, "CONSISTENCY-IMPORTER": UTV,
    "CONSISTENCY-COUNTRY-ORIGIN": UTV, "X-RANGE": PASS, "X-ODD": UTV,
}
_LIFTED = {k: NA for k in PLAIN if k != "R6-1C-NET-QUANTITY"}
#: What each case changes.
CHANGED = (
    {}, _LIFTED, _LIFTED, {}, _LIFTED,
    {"R6-2-CONSUMER-CARE": PASS},
    {"R26-EXEMPT-FAST-FOOD": NMR},
    {"R26-EXEMPT-DRUG-FORMULATIONS": NMR},
    {"R26-EXEMPT-THREAD-COIL": NMR},
    {"R11-QTY-BASIS": PNC},
    {"R6-11-UNIT-SALE-PRICE": PNC},
    {"R6-1AA-COUNTRY-ORIGIN": NA, "CONSISTENCY-MANUFACTURER": PASS},
    {"R6-1AA-COUNTRY-ORIGIN": NA, "CONSISTENCY-MANUFACTURER": PNC},
    {"CONSISTENCY-PRODUCT-NAME": PASS},
    {"R6-1AA-COUNTRY-ORIGIN": PASS, "CONSISTENCY-IMPORTER": PNC, "CONSISTENCY-COUNTRY-ORIGIN": PASS},
    {"X-RANGE": PNC},
    {"R10-NAME-ADDR-FORM": NMR},
    {"R10-NAME-ADDR-FORM": PASS},
    _LIFTED, {},
    {"R6-1E-MRP": PASS, "R6-11-UNIT-SALE-PRICE": PASS, "R31-ADVERTISEMENT-NET-QTY": NMR, "CONSISTENCY-MRP": PNC},
    {"R6-1D-MFG-DATE": PASS},
    {"R6-1D-MFG-DATE": PNC},
    {"R6-1D-MFG-DATE": PASS},
)


def _said(case: int) -> list[tuple[str, str, str, float]]:
    """(field, value, source, confidence) that a case declares."""
    page, image, _ = CASES[case]
    shown = {"product_name": "Plain goods", "net_quantity": "500 g"} | page
    return [(f, v, "WEBPAGE_TEXT", 0.8) for f, v in shown.items()] + [(f, v, "IMAGE_OCR", 0.7) for f, v in image.items()]


def _contexts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(contexts, declarations) of one inspection a part. The cases are a table of a few dozen rows."""
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("i"), F.col("p_partkey").cast("string")).alias("inspection_id"), (F.col("p_partkey") % len(CASES)).cast("int").alias("c"))
    said = spark.createDataFrame([(i, *row, n) for i in range(len(CASES)) for n, row in enumerate(_said(i))], "c int, field_name string, field_value string, source_type string, confidence double, ord int")
    texts = spark.createDataFrame([(i, case[2]) for i, case in enumerate(CASES)], "c int, listing_text string")
    decl = declare.normalized(parts.join(F.broadcast(said), "c").drop("c"), "2024-06-15")
    ins = parts.join(F.broadcast(texts), "c").select("inspection_id", "listing_text", F.lit("UNKNOWN").alias("category"))
    pages = context.page_status(parts.select("inspection_id", F.lit("SUCCESS").alias("fetch_status")))
    images = parts.select("inspection_id", F.lit(1).cast("bigint").alias("n_images"), F.lit(0.9).alias("ocr_conf"))
    return context.build_context(ins, decl, pages, images), decl


_VALUES = ", ".join(f"({i}, '{k}', '{(PLAIN | change)[k]}')" for i, change in enumerate(CHANGED) for k in PLAIN)
_FOUND = f"found AS (SELECT 'i' || p_partkey AS inspection_id, e.rule_key, e.status FROM part JOIN (VALUES {_VALUES}) e(c, rule_key, status) ON p_partkey % {len(CASES)} = e.c)"


def rule_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part's inspection takes the branches of its case."""
    return rules.evaluate(_contexts(spark, sf_dir)[0], RULES).select("inspection_id", "rule_key", "status")


def status_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the outcomes of the cases as reports show them, counted by rule."""
    checks = report.labelled_checks(rules.evaluate(_contexts(spark, sf_dir)[0], RULES), {"Packaged Commodities Rules": "Packaged Commodities"})
    return checks.groupBy("rule_key", "status_label", "result", "action", "document_label").agg(F.count("*").alias("n"))


def source_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """declarations by what reports call their field and source."""
    return report.labelled_declarations(_contexts(spark, sf_dir)[1]).groupBy("field_label", "source_label").agg(F.count("*").alias("n"))


QUERIES |= {"rule_branches": rule_branches, "status_labels": status_labels, "source_labels": source_labels}

_TITLES = ", ".join("('{}', '{}')".format(r.rule_key, r.title.replace("'", "''")) for r in RULES)
ORACLES["rule_branches"] = f"WITH {_FOUND} SELECT * FROM found"
ORACLES["status_labels"] = f"""WITH {_FOUND}, t AS (SELECT * FROM (VALUES {_TITLES}) t(rule_key, title))
    SELECT rule_key, CASE status WHEN '{PASS}' THEN 'Pass' WHEN '{PNC}' THEN 'Potential Non-Compliance' WHEN '{NMR}' THEN 'Needs Manual Review' WHEN '{NA}' THEN 'Not Applicable' ELSE 'Unable to Verify' END AS status_label,
      CASE status WHEN '{PNC}' THEN 'Not detected / potentially non-compliant' WHEN '{NMR}' THEN 'Requires manual/visual review' WHEN '{UTV}' THEN 'Insufficient evidence captured' END AS result,
      CASE status WHEN '{PNC}' THEN 'Verify ' || title || ' directly on the package/listing before treating this as a violation.' WHEN '{NMR}' THEN 'Requires manual or visual verification by the officer.'
        WHEN '{UTV}' THEN 'Insufficient evidence was captured — re-inspect with clearer photos or listing data.' ELSE 'No action required.' END AS action,
      'Packaged Commodities' AS document_label, count(*) AS n FROM found JOIN t USING (rule_key) GROUP BY ALL"""
_SAID = ", ".join(f"({i}, '{f}', '{s}')" for i in range(len(CASES)) for f, _, s, _ in _said(i))
ORACLES["source_labels"] = f"""SELECT CASE f WHEN 'mrp' THEN 'MRP' WHEN 'net_quantity' THEN 'Net Quantity' WHEN 'product_name' THEN 'Product Name' WHEN 'manufacturer_name' THEN 'Manufacturer' WHEN 'importer_name' THEN 'Importer'
      WHEN 'country_of_origin' THEN 'Country of Origin' WHEN 'manufacturer_address' THEN 'Manufacturer Address' WHEN 'unit_sale_price' THEN 'Unit Sale Price' WHEN 'mfg_date' THEN 'Mfg Date'
      WHEN 'consumer_care_name' THEN 'Consumer Care Name' WHEN 'consumer_care_address' THEN 'Consumer Care Address' WHEN 'consumer_care_phone' THEN 'Consumer Care Phone' ELSE 'Consumer Care Email' END AS field_label,
    CASE s WHEN 'WEBPAGE_TEXT' THEN 'WEBPAGE' ELSE 'IMAGE/OCR' END AS source_label, count(*) AS n FROM part JOIN (VALUES {_SAID}) v(c, f, s) ON p_partkey % {len(CASES)} = v.c GROUP BY ALL"""
