"""From captured pages to checks in one job: HTML -> candidates -> declarations -> contexts -> checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from packlens.operators import context, declare, ocr, rules
from packlens.plans import audit
from packlens.plans.synth import listing_text
from packlens.sources import html_parts as H
from packlens.streaming.scan import Scan


def candidates(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Candidates of all strategies for pages (key, url, html). Each page is parsed once: its parts, which are no larger
    than the page, are kept on the executors' disks for the strategies, and parsed again where an executor is lost."""
    return H.page_candidates(H.html_parts(pages, key).persist(StorageLevel.DISK_ONLY), key)


def declarations(pages: DataFrame, key: str = "inspection_id", as_of: str | None = None) -> DataFrame:
    """What the pages declare, each value once; text that carries no structure is told apart by its source. as_of: the day
    that lends dates their missing parts; with it dates in any wording are read."""
    source = F.when(F.col("strategy") == "FALLBACK_TEXT", "WEBPAGE_TEXT").otherwise("STRUCTURED_METADATA")
    found = candidates(pages, key).withColumn("source_type", source)
    rows = found.select(key, "field_name", "field_value", "confidence", "ord", "source_type")
    return declare.dedup_candidates(declare.normalized(rows, as_of), [key])


def image_declarations(images: DataFrame, boxes: DataFrame, as_of: str | None = None) -> DataFrame:
    """What the words on an inspection's images (image_id, inspection_id) declare, each value once an image."""
    found = ocr.ocr_declarations(ocr.image_words(ocr.reading_order(boxes))).join(images.hint("merge"), "image_id")
    rows = declare.normalized(found.withColumn("source_type", F.lit("IMAGE_OCR")), as_of)
    return declare.dedup_candidates(rows, ["image_id"]).select("inspection_id", "field_name", "field_value", "confidence", "ord", "source_type", "normalized_value")


def checks(lst: DataFrame, as_of: str | None = None) -> DataFrame:
    """Every rule on every listing, from its page's HTML and the words on its images."""
    return judged(lst, all_declarations(lst, as_of))


def judged(lst: DataFrame, decl: DataFrame) -> DataFrame:
    """Every rule on listings with these declarations; how well their images could be read comes from the words' boxes."""
    return rules.evaluate(audit.contexts(lst, decl, context.image_facts(listing_images(lst), listing_boxes(lst))))


def all_declarations(lst: DataFrame, as_of: str | None = None) -> DataFrame:
    """What pages and images of listings declare."""
    return declarations(listing_pages(lst), as_of=as_of).unionByName(image_declarations(listing_images(lst), listing_boxes(lst), as_of))


def listing_images(lst: DataFrame) -> DataFrame:
    """(image_id, inspection_id): a listing's images, of which the first one shows its label."""
    each = F.explode(F.sequence(F.lit(1), F.col("n_images").cast("int")))
    some = lst.filter("n_images > 0").select("inspection_id", each.alias("i"))
    return some.select(F.concat("inspection_id", F.lit("-"), F.col("i").cast("string")).alias("image_id"), "inspection_id")


def listing_boxes(lst: DataFrame) -> DataFrame:
    """The words on the first image of each listing, a declaration a line, slightly uneven and in no order."""
    lines = [("MRP: Rs. ", "ocr_mrp"), ("Net Quantity: ", "ocr_qty"), ("Country of Origin: ", "ocr_country")]
    word = lambda y: lambda w, i: F.struct(w.alias("text"), (i * 50).alias("x"), (F.lit(y) + i % 3).alias("y"))
    shown = [F.when(F.col(c).isNotNull(), F.transform(F.split(F.concat(F.lit(label), F.col(c)), " "), word(30 * n))) for n, (label, c) in enumerate(lines)]
    none = F.array().cast("array<struct<text:string,x:int,y:int>>")
    words = F.concat(F.array(F.struct(F.lit("Label").alias("text"), F.lit(0).alias("x"), F.lit(-30).alias("y"))), *[F.coalesce(x, none) for x in shown])
    each = lst.filter("n_images > 0").repartition("inspection_id").select(F.concat("inspection_id", F.lit("-1")).alias("image_id"), F.col("ocr_conf").cast("double").alias("confidence"), F.posexplode(F.reverse(words)).alias("ord", "w"))
    box = F.struct(F.col("w.x").alias("x"), F.col("w.y").alias("y"), F.lit(40).alias("width"), F.lit(12).alias("height"))
    return each.select("image_id", "ord", "w.text", "confidence", box.alias("bbox"))


def incremental(spark: SparkSession, folder: str, schema: StructType, derive: Callable[[DataFrame], DataFrame] = all_declarations) -> Scan:
    """The job of `checks` as one that captures of listings (synth's columns and fetched_at) keep up to date in folder;
    derive: how declarations come from them, if not from the pages' HTML."""
    product = lambda c: c.select("url", "title", "brand", F.lit(None).cast("string").alias("description"), F.regexp_extract(F.coalesce("mrp_text", F.lit("")), r"[\d.]+", 0).try_cast("decimal(12,2)").alias("listed_price"), F.lit("INR").alias("currency"), "fetched_at")
    return Scan(spark, folder, schema, derive, judged, product)


def listing_pages(lst: DataFrame) -> DataFrame:
    """(inspection_id, url, html): the page that each fetched listing has, laid out as its platform does. Listings are dealt
    out first, as a file of many has few splits."""
    ok = lst.filter("has_page AND fetch_status = 'SUCCESS'").repartition("inspection_id")
    tag = lambda before, c, after: F.when(c.isNotNull(), F.concat(F.lit(before), c, F.lit(after))).otherwise(F.lit(""))
    title, qty, land = F.col("title"), F.col("qty_text"), F.col("country_text")
    bullet = lambda label, c: tag(f"<li><b>{label} ‏ : ‎</b> ", c, "</li>")
    row = lambda label, c: tag(f'<div class="grid-formation-dynamic"><div><div>{label}</div><div>', c, "</div><div></div></div></div>")
    body: dict[str, list[Column]] = {
        "amazon": [
            tag('<meta property="og:title" content="Amazon"><span id="productTitle"> ', title, ' </span><div id="detailBullets_feature_div"><ul>'),
            bullet("Net Quantity", qty), bullet("Country of Origin", land), F.lit("<li>Is Discontinued By Manufacturer : No</li></ul></div>"),
        ],
        "flipkart": [tag('<h1 class="v1">', title, "</h1>"), row("Net Quantity", qty), row("Country of Origin", land), row("Brand", F.col("brand"))],
        "blinkit": [tag('<h1 class="x Title">', title, "</h1>"), tag('<div class="PackSize-a">', qty, "</div>"), tag('<span class="CountryOfOrigin-b">', land, "</span>")],
    }
    other = [tag('<meta property="og:title" content="Shop: ', title, '"><script type="application/ld+json">{"@type":"Product","name":"'), tag("", title, '"}</script>')]
    inner = F.concat(*other)
    for name, parts in body.items():
        inner = F.when(F.col("platform") == name, F.concat(*parts)).otherwise(inner)
    html = F.concat(F.lit("<html><head><title>"), title, F.lit("</title></head><body>"), inner, F.lit("<p>"), listing_text(), F.lit("</p></body></html>"))
    return ok.select("inspection_id", "url", html.alias("html"))
