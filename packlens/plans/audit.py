"""The listing audit end to end: listings -> declarations -> contexts -> checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packlens.operators import classify, context, declare, rules
from packlens.plans.synth import listing_text, listings


def page_declarations(lst: DataFrame, as_of: str | None = None) -> DataFrame:
    """Declarations of the fetched pages: the title as structured data, the rest from the text. as_of: see declare.normalized.
    Listings are small rows that take long to read: they are dealt out first, as a file of many has few splits, and by
    the key that what follows groups by, so that declarations stay where they are found."""
    ok = lst.filter("has_page AND fetch_status = 'SUCCESS'").repartition("inspection_id").withColumn("text", listing_text())
    found = declare.text_declarations(ok, ["inspection_id"], "text").withColumn("source_type", F.lit("WEBPAGE_TEXT"))
    title = ok.select(
        "inspection_id", F.lit("product_name").alias("field_name"), F.col("title").alias("field_value"), F.lit(0.6).alias("confidence"), F.lit(0).alias("ord"),
        F.lit("STRUCTURED_METADATA").alias("source_type"),
    )
    return declare.dedup_candidates(declare.normalized(title.unionByName(found), as_of), ["inspection_id"])


def image_declarations(lst: DataFrame) -> DataFrame:
    """What the images of a listing say, as its OCR columns give it."""
    rows = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(c).alias("field_value"), F.lit(i).alias("ord")) for i, (f, c) in enumerate((("mrp", "ocr_mrp"), ("net_quantity", "ocr_qty"), ("country_of_origin", "ocr_country")))])
    seen = lst.repartition("inspection_id").select("inspection_id", F.col("ocr_conf").cast("double").alias("confidence"), F.inline(rows)).filter("field_value IS NOT NULL")
    return declare.normalized(seen.withColumn("source_type", F.lit("IMAGE_OCR")))


def declarations(lst: DataFrame, as_of: str | None = None) -> DataFrame:
    return page_declarations(lst, as_of).unionByName(image_declarations(lst))


def contexts(lst: DataFrame, decl: DataFrame | None = None, images: DataFrame | None = None) -> DataFrame:
    """One row per listing; decl: its declarations, if not those of its text; images: (inspection_id, n_images, ocr_conf), if
    not its own columns."""
    facts = context.page_status(lst.filter("has_page").select("inspection_id", "fetch_status"))
    if images is None:
        images = lst.filter("n_images > 0").select("inspection_id", "n_images", F.col("ocr_conf").cast("double").alias("ocr_conf"))
    ins = lst.repartition("inspection_id").select(
        "inspection_id", "batch_id", "platform", "url", "run_status", "created_day", F.concat_ws(" ", "url", "title").alias("listing_text"),
        classify.classify(F.concat_ws(" ", "title", "brand"))["category"].alias("category"),
    )
    return context.build_context(ins, declarations(lst) if decl is None else decl, facts, images)


def checks(lst: DataFrame, as_of: str | None = None) -> DataFrame:
    """Every rule on every listing. as_of: the day that lends dates their missing parts; with it dates in any wording are read."""
    return rules.evaluate(contexts(lst, declarations(lst, as_of)))


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks(listings(spark, sf_dir))
