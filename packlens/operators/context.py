"""What the rules need to know of an inspection, one row each. Every side is aggregated before it is joined. Sides have a row an
inspection, page or image, so joins are merges: Spark would judge a side by its compressed files and broadcast it from the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlens.functions.text import not_blank
from packlens.functions.vocab import LISTING_SOURCES

from .declare import source_rank

BEST = "struct<value:string,norm:string,source:string,confidence:double>"


def field_maps(decl: DataFrame, key: str = "inspection_id") -> DataFrame:
    """Per inspection: best (field -> best declaration), web (fields with a value from the listing itself),
    texts (field -> all values), online and image (field -> best of that side). At most 18 fields each."""
    order = F.struct(F.col("confidence"), -source_rank(F.col("source_type")), -F.col("ord"))
    row = F.struct(
        F.col("field_value").alias("value"), F.col("normalized_value").alias("norm"), F.col("source_type").alias("source"), F.col("confidence").alias("confidence")
    )
    listed = F.col("source_type").isin(*LISTING_SOURCES)
    seen = F.col("source_type") == "IMAGE_OCR"
    per = decl.groupBy(key, "field_name").agg(
        F.max_by(row, order).alias("best"),
        F.bool_or(listed & not_blank(F.col("field_value"))).alias("web"),
        F.max_by(row, F.when(listed, order)).alias("online"),
        F.max_by(row, F.when(seen, order)).alias("image"),
        F.concat_ws(" ", F.array_sort(F.collect_set("field_value"))).alias("texts"),
    )
    per = per.withColumns({"online": F.when(F.col("online.source").isin(*LISTING_SOURCES), F.col("online")), "image": F.when(F.col("image.source") == "IMAGE_OCR", F.col("image"))})
    pick = lambda c: F.map_from_entries(F.filter(F.collect_list(F.struct("field_name", c)), lambda e: e[c].isNotNull())).alias(c)
    return per.groupBy(key).agg(pick("best"), pick("web"), pick("texts"), pick("online"), pick("image"))


def evidence_quality(usable_page: Column, n_images: Column, ocr_conf: Column) -> Column:
    """Mean of three signals: a usable page, any image, and the mean OCR confidence."""
    ocr = F.coalesce(ocr_conf, F.when(n_images > 0, F.lit(0.15)).otherwise(F.lit(0.5)))
    return (F.when(usable_page, 1.0).otherwise(0.0) + F.when(n_images > 0, 1.0).otherwise(0.3) + ocr) / 3


def page_facts(pages: DataFrame, candidates: DataFrame, key: str = "inspection_id") -> DataFrame:
    """Per inspection: has_page_row, hollow (a fetched page with at most one distinct field), usable_page."""
    fields = candidates.groupBy("page_id").agg(F.count_distinct("field_name").alias("n_fields"))
    p = pages.join(fields.hint("merge"), "page_id", "left").withColumn("n_fields", F.coalesce("n_fields", F.lit(0)))
    ok = F.col("fetch_status") == "SUCCESS"
    return p.groupBy(key).agg(
        F.lit(True).alias("has_page_row"), F.bool_or(ok & (F.col("n_fields") <= 1)).alias("hollow"), F.bool_or(ok & (F.col("n_fields") > 1)).alias("usable_page")
    )


def page_status(pages: DataFrame, key: str = "inspection_id") -> DataFrame:
    """Per inspection: has_page_row and fetched. build_context finds out itself whether the page is hollow,
    from the fields of its declarations, which spares a second pass over the candidates."""
    return pages.groupBy(key).agg(F.lit(True).alias("has_page_row"), F.bool_or(F.col("fetch_status") == "SUCCESS").alias("fetched"))


def image_facts(images: DataFrame, boxes: DataFrame, key: str = "inspection_id") -> DataFrame:
    """Per inspection: n_images and ocr_conf, the mean confidence over all boxes of all images."""
    per = boxes.groupBy("image_id").agg(F.sum("confidence").alias("c"), F.count("confidence").alias("n"))
    return images.join(per.hint("merge"), "image_id", "left").groupBy(key).agg(F.count("*").alias("n_images"), (F.sum("c") / F.sum("n")).alias("ocr_conf"))


def origin(best: Column, has_page_row: Column, n_images: Column) -> Column:
    """IMPORTED, DOMESTIC or UNKNOWN."""
    has = lambda f: not_blank(F.try_element_at(best, F.lit(f))["value"])
    maker = has("manufacturer_name") | has("packer_name")
    return F.when(has("importer_name"), "IMPORTED").when((has_page_row | (n_images > 0)) & maker, "DOMESTIC").otherwise("UNKNOWN")


def build_context(inspections: DataFrame, decl: DataFrame, pages: DataFrame, images: DataFrame, key: str = "inspection_id") -> DataFrame:
    """One row per inspection; pages (page_facts or page_status) and images are facts per inspection."""
    maps = field_maps(decl, key)
    c = inspections.join(maps.hint("merge"), key, "left").join(pages.hint("merge"), key, "left").join(images.hint("merge"), key, "left")
    empty = lambda kind: F.create_map().cast(f"map<string,{kind}>")
    fill = {"best": BEST, "web": "boolean", "texts": "string", "online": BEST, "image": BEST}
    c = c.withColumns({n: F.coalesce(F.col(n), empty(k)) for n, k in fill.items()})
    if "fetched" in c.columns:
        several = F.size("online") > 1
        c = c.withColumns({"hollow": F.col("fetched") & ~several, "usable_page": F.col("fetched") & several})
    c = c.withColumns({n: F.coalesce(F.col(n), F.lit(v)) for n, v in {"has_page_row": False, "hollow": False, "usable_page": False}.items()})
    c = c.withColumn("n_images", F.coalesce("n_images", F.lit(0).cast("bigint")))
    c = c.withColumns({"quality": evidence_quality(F.col("usable_page"), F.col("n_images"), F.col("ocr_conf")), "sufficient": F.col("usable_page") | (F.col("n_images") > 0)})
    return c.withColumn("origin", origin(F.col("best"), F.col("has_page_row"), F.col("n_images")))
