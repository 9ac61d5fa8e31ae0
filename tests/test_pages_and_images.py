import struct
import zlib

from packlens.operators import images, ocr
from packlens.sources import html_parts as H
from packlens.sources import readers
from packlens.streaming.scan import latest_captures, scan_folder
from pyspark.sql import functions as F

PAGE = """<html><head><title> Shop | Chips </title><meta name="description" content="Crunchy"><meta property="og:title" content="Old"><meta property="og:title" content="Northway Crisps">
<meta property="og:image" content="http://x/og.png"><script type="application/ld+json">{"@graph":[{"@type":"Thing"},{"@type":["Product"],"name":"Chips","brand":{"name":"Northway"},"image":"http://x/1.png",
"offers":{"price":"71.00","priceCurrency":"INR"}}]}</script><script type="application/ld+json">{broken</script></head><body><h1 id="title">Northway Root Crisps</h1><p>one<p>two <b>MRP: Rs. 84.50
<table><tr><td>Net Quantity</td><td>100 g</td></tr><tr><th>Packed By</th><td>Packer Co</td></tr><tr><td>lone</td></tr></table><table><tr><td>MRP</td><td>5</td></tr></table>
<ul><li>Country of Origin ‎:‏ India</li><li>Is Discontinued By Manufacturer : No</li></ul><div><span>Manufacturer</span><span>Maker Co</span><i> </i></div>
<img src="/a.png"><img data-src="http://x/1.png"><style>p{}</style></body>"""


def parts(spark, html=PAGE, url="http://h/q/"):
    return H.html_parts(spark.createDataFrame([("p", url, html)], "page_id string, url string, html string")).cache()


def test_structured_data(spark):
    p = parts(spark)
    prod = H.json_ld_products(p)
    cands = {r.field_name: (r.field_value, r.confidence) for r in H.json_ld_candidates(prod).collect()}
    assert cands == {"product_name": ("Chips", 0.95), "manufacturer_name": ("Northway", 0.3)}
    assert {r.prop: r.content for r in H.open_graph(p).collect()}["og:title"] == "Northway Crisps"
    rec = H.product_record(p, prod).first()
    assert (rec.title, rec.description, rec.brand, float(rec.listed_price), rec.currency) == ("Northway Crisps", "Crunchy", "Northway", 71.0, "INR")
    assert list(H.page_images(p, prod).first().urls) == ["http://x/1.png", "http://x/og.png", "http://h/a.png"]


def test_tables_bullets_grids_and_selectors(spark):
    p = parts(spark)
    pairs = H.table_pairs(p).unionByName(H.bullet_pairs(p))
    got = {(r.field_name, r.field_value) for r in H.label_candidates(pairs).collect()}
    assert got == {("net_quantity", "100 g"), ("packer_name", "Packer Co"), ("country_of_origin", "India"), ("manufacturer_name", "Maker Co")}
    hit = H.selector_hits(parts(spark, url="https://www.amazon.in/dp/1")).first()
    assert (hit.field_name, hit.field_value, hit.confidence) == ("product_name", "Northway Root Crisps", 0.7)
    text = H.visible_text(p).first().text
    assert "MRP: Rs. 84.50" in text and "broken" not in text and "p{}" not in text and "| |" not in text


def test_broken_and_empty_pages(spark):
    for html in ("<div><p>x<table><tr><td>a", "", None, "<", "<script>", "</p></p>"):
        assert parts(spark, html).filter("part = 'text'").count() == 1


def test_ocr_reading_order_and_declarations(spark):
    raw = [("m", 0, "84.50", 60, 101), ("m", 1, "MRP:", 0, 100), ("m", 2, "Rs.", 30, 104), ("m", 3, "100", 70, 140), ("m", 4, "Qty:", 30, 141), ("m", 5, "Net", 0, 139), ("m", 6, "g", 90, 141), ("n", 0, "x", 0, 0)]
    boxes = spark.createDataFrame([(i, o, t, 0.9 if t == "84.50" else 0.5, (x, y, 20, 12), "e") for i, o, t, x, y in raw], readers.BOX)
    texts = ocr.image_words(ocr.reading_order(boxes)).cache()
    assert {r.image_id: r.blob for r in ocr.image_text(texts).collect()} == {"m": "MRP: Rs. 84.50 \nNet Qty: 100 g", "n": "x"}
    got = {r.field_name: r for r in ocr.ocr_declarations(texts).collect()}
    assert (got["mrp"].field_value, got["mrp"].confidence, got["mrp"].source_box) == ("84.50", 0.765, 0) and got["net_quantity"].field_value == "100 g"
    clean = ocr.clean_boxes(spark.createDataFrame([("a", "95"), (" ", "9"), ("b", "-1"), ("c", "x")], "text string, conf string")).collect()
    assert [(r.text, r.confidence) for r in clean] == [("a", 0.95), ("b", 0.0), ("c", 0.0)]


def png(path, rows):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"".join(b"\0" + bytes(r) for r in rows)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_quality(spark, tmp_path):
    png(tmp_path / "sharp.png", [[255 * ((x // 4 + y // 4) % 2) for x in range(64)] for y in range(64)])
    png(tmp_path / "soft.png", [[int(255 * (x + y) / 128) for x in range(64)] for y in range(64)])
    png(tmp_path / "white.png", [[255] * 64] * 64)
    got = {r.origin.rsplit("/", 1)[1]: r for r in images.quality(readers.images(spark, str(tmp_path))).collect()}
    assert not got["sharp.png"].is_blurry and got["soft.png"].is_blurry and not got["white.png"].glare_detected and "low resolution" in got["sharp.png"].quality_notes
    assert readers.image_files(spark, str(tmp_path)).count() == 3


def test_stream_equals_batch(spark, tmp_path):
    schema = "page_id string, url string, html string, fetched_at timestamp"
    rows = spark.createDataFrame([(f"p{i}", f"http://h/{i % 5}", PAGE) for i in range(8)], "page_id string, url string, html string").withColumn("fetched_at", F.timestamp_seconds(F.substring("page_id", 2, 9).cast("long")))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    job = lambda b: H.label_candidates(H.table_pairs(H.html_parts(b)))
    args = (spark, str(tmp_path / "in"), schema, job, str(tmp_path / "out"), str(tmp_path / "cp"))
    scan_folder(*args, max_files=1).awaitTermination()
    scan_folder(*args).awaitTermination()
    cols = ["page_id", "field_name", "field_value"]
    assert sorted(spark.read.parquet(str(tmp_path / "out")).select(cols).collect()) == sorted(job(rows).select(cols).collect())
    assert latest_captures(rows).count() == 5


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "b1.txt").write_text("http://a\nhttp://b\n")
    assert [(r.pos, r.url) for r in readers.url_list(spark, str(tmp_path / "b1.txt")).orderBy("pos").collect()] == [(0, "http://a"), (1, "http://b")]
    (tmp_path / "p.html").write_text(PAGE)
    assert readers.saved_pages(spark, str(tmp_path / "p.html")).first().html == PAGE
    for n in (3, 2):
        readers.write_results("2024-01-01", str(tmp_path / "res"), checks=spark.range(n), violations=spark.range(1))
    assert spark.read.parquet(str(tmp_path / "res/checks")).count() == 2


def test_texts_of_long_pages_are_whole(spark, tmp_path):
    from packlens.plans import registry

    rows = [(i, "http://h/q/", "<body><p>" + "long word " * 3000 + end + "</p></body>") for i, end in enumerate(("one", "two"))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = registry.QUERIES["page_texts"](spark, str(tmp_path)).collect()
    assert len({r.text_hash for r in got}) == 2 and all(r.n_chars > 30_000 for r in got)


AMAZON = """<meta property="og:title" content="Amazon"><span id="productTitle"> Oat Bars 90g </span><table id="productDetails_techSpec_section_1"><tr><th>Manufacturer</th><td>Hill Bakery</td></tr>
<tr><th>Net Weight</th><td>100 g</td></tr></table><table><tr><td>MRP</td><td>312.40</td></tr><tr><td>Packer</td><td>Other</td></tr></table><div id="detailBullets_feature_div"><li>M.R.P ‏ : ‎ Rs. 84.50</li>
<li>Is Discontinued By Manufacturer : No</li></div><ul><li>Importer : Elsewhere</li></ul>"""
FLIPKART = """<h1 class="v1">Real Name</h1><div class="grid-formation-dynamic"><div><div>Net Quantity</div><div>500 g</div><div></div></div></div><div class="grid-formation-dynamic"><div><div>Manufactured By</div>
<div>Northway Foods</div><div></div></div></div><div><div>Packer</div><div>Elsewhere</div></div><table><tr><td>See also</td><td>Other</td></tr></table>"""
BLINKIT = """<h1 class="ProductName-x"></h1><h1 class="a Title">Late</h1><h1>Plain</h1><div class="Price-MRP">Rs. 20</div><div class="Price-now">Rs. 15</div><i data-testid="mrp">9</i><p class="PackSize__q">1 kg</p>
<div class="SellerOrigin">Nepal</div>"""
GENERIC = """<meta property="og:title" content="Shop chips"><script type="application/ld+json">{"@type":"Product","name":"Chips","manufacturer":"Maker"}</script><h1>Not used</h1><p>Country of Origin: India</p>
<table><tr><td>Packer</td><td>a</td></tr><tr><td>Importer</td><td>b</td></tr></table>"""


def test_candidates_of_platforms(spark):
    pages = [("a", "https://www.amazon.in/dp/1", AMAZON), ("f", "https://www.flipkart.com/x", FLIPKART), ("b", "https://blinkit.com/prn/1", BLINKIT), ("g", "http://shop.example", GENERIC), ("n", None, None)]
    rows = H.page_candidates(H.html_parts(spark.createDataFrame(pages, "page_id string, url string, html string"))).collect()
    got = {(r.page_id, r.strategy, r.field_name, r.field_value, r.confidence) for r in rows if r.strategy != "FALLBACK_TEXT"}
    css = lambda page, c, **fields: {(page, "CSS_SELECTOR", k, v, c) for k, v in fields.items()}
    assert got == (
        {("a", "OPEN_GRAPH", "product_name", "Amazon", 0.6)}
        | css("a", 0.7, product_name="Oat Bars 90g")
        | css("a", 0.75, manufacturer_name="Hill Bakery", net_quantity="100 g", mrp="Rs. 84.50")
        | css("f", 0.6, product_name="Real Name")
        | css("f", 0.75, net_quantity="500 g", manufacturer_name="Northway Foods")
        | css("b", 0.65, product_name="Late", mrp="Rs. 20", price="Rs. 15", net_quantity="1 kg", country_of_origin="Nepal")
        | {("g", "JSON_LD", "product_name", "Chips", 0.95), ("g", "JSON_LD", "manufacturer_name", "Maker", 0.85), ("g", "OPEN_GRAPH", "product_name", "Shop chips", 0.6)}
    )
    text = {(r.page_id, r.field_name, r.field_value) for r in rows if r.strategy == "FALLBACK_TEXT"}
    assert ("g", "country_of_origin", "India") in text and not any(r.page_id == "n" for r in rows)
    order = [r.strategy for r in sorted((r for r in rows if r.page_id == "g"), key=lambda r: r.ord)]
    assert order == sorted(order, key=["JSON_LD", "OPEN_GRAPH", "FALLBACK_TEXT"].index)
