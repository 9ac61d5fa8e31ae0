"""Products: one row per URL hash, kept up to date by captures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlens.functions.text import url_hash

FIELDS = ("title", "brand", "description", "listed_price", "currency")


def upsert(products: DataFrame, captures: DataFrame) -> DataFrame:
    """Non-empty new values win over old ones; of several captures of a URL the last non-empty value counts.
    Captures are reduced per URL before the join, so a popular URL is one row."""
    c = captures.withColumn("url_hash", url_hash(F.col("url")))
    text = lambda f: F.nullif(F.col(f).cast("string"), F.lit(""))
    latest = [F.max_by(f, F.when(text(f).isNotNull(), F.col("fetched_at"))).alias(f"new_{f}") for f in FIELDS]
    new = c.groupBy("url_hash").agg(*latest, F.max("fetched_at").alias("seen"), F.min("url").alias("new_url"))
    j = products.join(new, "url_hash", "full_outer")
    pick = {f: F.coalesce(F.when(F.nullif(F.col(f"new_{f}").cast("string"), F.lit("")).isNotNull(), F.col(f"new_{f}")), F.col(f)) for f in FIELDS}
    pick["currency"] = F.coalesce(pick["currency"], F.lit("INR"))
    return j.select("url_hash", F.coalesce("canonical_url", "new_url").alias("canonical_url"), *[e.alias(f) for f, e in pick.items()], F.coalesce("seen", "last_checked_at").alias("last_checked_at"))


def classification_text(inspections: DataFrame, names: DataFrame, ocr: DataFrame) -> DataFrame:
    """Title, brand, description, the best product name over all inspections of the product, and this
    inspection's image texts in order."""
    best = names.groupBy("product_id").agg(F.max_by("field_value", F.struct("confidence", F.col("inspection_id"))).alias("best_name"))
    texts = ocr.groupBy("inspection_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("image_id", "text"))), lambda x: x["text"]), " ").alias("ocr_text"))
    j = inspections.join(best, "product_id", "left").join(texts, "inspection_id", "left")
    return j.withColumn("class_text", F.concat_ws(" ", "title", "brand", "description", "best_name", "ocr_text"))
