"""Listing frames made from the star-schema tables by SQL expressions that another engine can repeat.

Each expression below is SQL text; `columns_sql` gives the same text for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packlens.session import table

#: Expressions over part p joined with supplier s and its nation n; {fmt} is the engine's printf.
LISTING = {
    "k": "p_partkey",
    "inspection_id": "concat('i', cast(p_partkey as string))",
    "product_id": "concat('p', cast(p_partkey % 1500 as string))",
    "url": "concat('https://www.', case p_partkey % 4 when 0 then 'amazon.in' when 1 then 'flipkart.com' when 2 then 'blinkit.com' else 'shop.example.com' end, '/p/', cast(p_partkey as string))",
    "platform": "case p_partkey % 4 when 0 then 'amazon' when 1 then 'flipkart' when 2 then 'blinkit' else 'generic' end",
    "title": "concat(p_name, case p_partkey % 6 when 0 then ' chips snack' when 1 then ' soap' when 2 then ' floor cleaner' when 3 then ' tea' when 4 then ' tobacco tin' else '' end)",
    "brand": "p_brand",
    "batch_id": "concat('b', cast(p_partkey % 20 as string))",
    "officer_id": "concat('o', cast(p_partkey % 5 as string))",
    "run_status": "case when p_partkey % 17 = 0 then 'IN_PROGRESS' when p_partkey % 19 = 0 then 'FAILED' when p_partkey % 23 = 0 then 'CREATED' else 'COMPLETED' end",
    "created_day": "p_partkey % 60",
    "mrp_text": "case when p_partkey % 7 <> 0 then concat('Rs. ', {fmt}('%.2f', p_retailprice)) end",
    "qty_text": "case when p_partkey % 11 <> 0 then concat(cast(p_size as string), case when p_partkey % 5 = 0 then ' kg' when p_partkey % 6 = 0 then ' ml' else ' g' end) end",
    "maker_text": "case when p_partkey % 13 <> 0 then concat('Maker ', cast(s_suppkey as string)) end",
    "maker_addr": "case when p_partkey % 13 <> 0 then 'Plot One, Pune 411001' end",
    "importer_text": "case when p_partkey % 9 = 0 then 'Global Goods Ltd' end",
    "importer_addr": "case when p_partkey % 9 = 0 then 'Dock 5 Mumbai 400001' end",
    "country_text": "case when p_partkey % 10 <> 0 then case n_nationkey % 3 when 0 then 'India' when 1 then 'Nepal' else 'Sri Lanka' end end",
    "care_name": "case when p_partkey % 4 <> 0 then 'Help Desk' end",
    "care_phone": "case when p_partkey % 4 <> 0 then '1800-123-4567' end",
    "care_email": "case when p_partkey % 4 <> 0 then 'care@shop.example' end",
    "mfg_text": "case when p_partkey % 3 = 0 then '05/2024' end",
    "best_text": "case when p_partkey % 5 = 1 then '12/2025' end",
    "unit_text": "case when p_partkey % 8 = 0 and p_partkey % 7 <> 0 then {fmt}('%.2f', p_retailprice) end",
    "packed_note": "case when p_partkey % 29 = 0 then 'when packed' end",
    "fetch_status": "case when p_partkey % 10 = 3 then 'ACCESS_DENIED' when p_partkey % 10 = 7 then 'TIMEOUT' else 'SUCCESS' end",
    "has_page": "p_partkey % 31 <> 0",
    "n_images": "cast(case when p_partkey % 3 = 0 then 0 else 1 + p_partkey % 2 end as bigint)",
    "ocr_conf": "round(0.15 + (p_partkey % 80) / 100.0, 2)",
    "ocr_mrp": "case when p_partkey % 3 <> 0 and p_partkey % 7 <> 0 then case when p_partkey % 9 = 0 then {fmt}('%.2f', p_retailprice + 10) else {fmt}('%.2f', p_retailprice) end end",
    "ocr_qty": "case when p_partkey % 3 <> 0 and p_partkey % 11 <> 0 then concat(cast(case when p_partkey % 8 = 1 then p_size + 1 else p_size end as string), case when p_partkey % 5 = 0 then ' kg' when p_partkey % 6 = 0 then ' ml' else ' g' end) end",
    "ocr_country": "case when p_partkey % 3 <> 0 and p_partkey % 10 <> 0 then case n_nationkey % 3 when 0 then 'India' when 1 then 'Nepal' else 'Sri Lanka' end end",
}

#: label shown before the value in the listing's text, by column
LABELS = (
    ("MRP: ", "mrp_text"),
    ("Net Quantity: ", "qty_text"),
    ("Country of Origin: ", "country_text"),
    ("Consumer Care: ", "care_name"),
    ("Helpline: ", "care_phone"),
    ("", "care_email"),
    ("Mfg Date: ", "mfg_text"),
    ("Best Before: ", "best_text"),
    ("Unit Sale Price: ", "unit_text"),
)
FROM = "part p join supplier s on s_suppkey = p_partkey % (select count(*) from supplier) join nation n on n_nationkey = s_nationkey"


def listing_sql() -> str:
    """The CTE body for the oracle engine."""
    cols = ", ".join(f"{e.replace('{fmt}', 'printf')} AS {c}" for c, e in LISTING.items())
    return f"SELECT {cols} FROM {FROM}".replace("as string", "as varchar")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part: what an inspection of a product listing knows."""
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    nation = table(spark, sf_dir, "nation").select("n_nationkey")
    n = supplier.agg(F.count("*").alias("n_suppliers"))
    p = part.crossJoin(F.broadcast(n)).withColumn("sk", F.col("p_partkey") % F.col("n_suppliers"))  # one row, for the modulo
    s = supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    joined = p.join(s, F.col("sk") == F.col("s_suppkey"))
    return joined.selectExpr(*[f"{e.replace('{fmt}', 'format_string')} AS {c}" for c, e in LISTING.items()])


def listing_text() -> object:
    """The page text: labelled values apart by bars, with maker and importer followed by their addresses."""
    parts = [F.when(F.col(c).isNotNull(), F.concat(F.lit(label), F.col(c))) for label, c in LABELS]
    for label, name, addr in (("Manufactured by: ", "maker_text", "maker_addr"), ("Imported by: ", "importer_text", "importer_addr")):
        parts.append(F.when(F.col(name).isNotNull(), F.concat(F.lit(label), F.col(name), F.lit(", "), F.col(addr))))
    parts.append(F.col("packed_note"))
    return F.concat_ws(" | ", *parts)
