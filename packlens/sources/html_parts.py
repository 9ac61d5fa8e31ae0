"""One pass over a page's HTML. The helper emits raw parts in long form; all that follows is DataFrame code.

Parts (part, ord, k1, k2, text): jsonld, meta (k1 name, k2 content), title, row (k1 its table, k2 label and text value if
the row has two filled cells, else null), bullet (k1 label), grid (k1 label), img (k1 alt), sel (k1 field, k2 confidence: hits
of the platform's selectors), headline (k1 wins or fills: what a platform's selectors take for the title), pair (k1
label: pairs from the platform's own places), text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlens.functions.patterns import candidates
from packlens.functions.text import not_blank
from packlens.functions.vocab import LABELS
from packlens.operators.intake import platform
from packlens.sources.selectors import PLATFORMS, bullet, field_hits, label_pairs

PART = "part string, ord int, k1 string, k2 string, text string"
#: Pages that a task holds as Python objects at a time.
PAGES = 50
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_HIDDEN = {"script", "style", "noscript", "svg"}


class _Node:
    __slots__ = ("attrs", "kids", "tag", "up")

    def __init__(self, tag: str, attrs: dict, up: _Node | None = None):
        self.tag, self.attrs, self.up, self.kids = tag, attrs, up, []

    def text(self, sep: str = " ") -> str:
        out = []
        stack = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                if n.strip():
                    out.append(" ".join(n.split()))
            elif n.tag not in _HIDDEN:
                stack.extend(reversed(n.kids))
        return sep.join(out)

    def above(self):
        n = self.up
        while n is not None:
            yield n
            n = n.up

    def walk(self):
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(k for k in reversed(n.kids) if isinstance(k, _Node))


class _Tree(HTMLParser):
    """A light tree that forgives unclosed and stray tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("#", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li", "tr", "td", "th") and self.open[-1].tag == tag:
            self.open.pop()
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.open[-1])
        self.open[-1].kids.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].kids.append(data)


def parts_of(html: str | None, url: str | None, site: str | None = None) -> list[tuple]:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    out: list[tuple] = []
    add = lambda part, k1, k2, text: out.append((part, len(out), k1, k2, text))
    nodes = list(tree.root.walk())
    place = {id(n): i for i, n in enumerate(nodes)}
    for n in nodes:
        if n.tag == "script" and n.attrs.get("type", "").lower() == "application/ld+json":
            add("jsonld", None, None, "".join(k for k in n.kids if isinstance(k, str)))
        elif n.tag == "meta":
            add("meta", (n.attrs.get("property") or n.attrs.get("name") or "").lower(), n.attrs.get("content"), None)
        elif n.tag == "title":
            add("title", None, None, " ".join("".join(k for k in n.kids if isinstance(k, str)).split()))
        elif n.tag == "tr":
            # a row belongs to the nearest table, whatever wraps it there, and a cell to the nearest row
            home = next((u for u in n.above() if u.tag == "table"), None)
            cells = [t for c in n.walk() if c.tag in ("td", "th") and next((u for u in c.above() if u.tag == "tr"), n) is n and (t := c.text())]
            label, value = cells if len(cells) == 2 else (None, None)
            add("row", str(place.get(id(home), 0)), label, value)
        elif n.tag == "li":
            if found := bullet(n.text()):
                add("bullet", found[0], None, found[1])
        elif n.tag == "img":
            add("img", n.attrs.get("alt"), None, urljoin(url or "", n.attrs.get("src") or n.attrs.get("data-src") or ""))
        if n.tag == "div":
            kids = [k for k in n.kids if isinstance(k, _Node) and k.text()]
            if len(kids) == 2 and not any(isinstance(k, str) and k.strip() for k in n.kids):
                add("grid", kids[0].text(), None, kids[1].text())
    if (known := PLATFORMS.get(site or "")) is not None:
        for name, text in field_hits(nodes, known):
            add("sel", name, str(known.confidence), text)
            if name == "product_name":
                add("headline", "wins" if known.title_wins else "fills", None, text)
        for label, value in label_pairs(nodes, known):
            add("pair", label, None, value)
    add("text", None, None, tree.root.text(" | "))
    return out


def html_parts(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, part, ord, k1, k2, text) of every page; the HTML goes no further. The platform, whose selectors are used, is
    told by the url."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # pages become Python objects a few at a time, as a batch has thousands
            types = [b.schema.field("key").type, pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
            for lo in range(0, b.num_rows, PAGES):
                c = b.slice(lo, PAGES)
                rows = [(k, *p) for k, h, u, site in zip(*(c.column(n).to_pylist() for n in ("key", "html", "url", "site")), strict=True) for p in parts_of(h, u, site)]
                cols = zip(*rows, strict=True)  # a page has at least its text
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], ["key", "part", "ord", "k1", "k2", "text"])

    src = pages.select(F.col(key).alias("key"), "html", "url", platform(F.col("url")).alias("site"))
    return src.mapInArrow(run, f"key {kind}, {PART}").withColumnRenamed("key", key)


def json_ld_products(parts: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, obj): the first Product object of a page. Arrays and @graph are flattened, broken JSON is skipped."""
    v = parts.filter("part = 'jsonld'").select(key, "ord", F.try_parse_json("text").alias("v")).filter("v IS NOT NULL")
    top = v.select(key, "ord", F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v")).alias("items"))
    one = top.select(key, "ord", F.posexplode("items").alias("i", "o"))
    graph = one.select(key, "ord", "i", F.coalesce(F.try_variant_get("o", "$['@graph']", "array<variant>"), F.array("o")).alias("items"))
    flat = graph.select(key, "ord", "i", F.posexplode("items").alias("j", "o"))
    kind = F.coalesce(F.try_variant_get("o", "$['@type']", "array<string>"), F.array(F.try_variant_get("o", "$['@type']", "string")))
    hit = flat.filter(F.exists(kind, lambda t: F.lower(t) == "product"))
    return hit.groupBy(key).agg(F.min_by(F.to_json("o"), F.struct("ord", "i", "j")).alias("obj")).select(key, F.parse_json("obj").alias("obj"))


def _text_or_name(obj: str, path: str) -> Column:
    inner = F.try_variant_get(obj, f"$.{path}.name", "string")
    is_text = F.schema_of_variant(F.try_variant_get(obj, f"$.{path}", "variant")) == "STRING"
    return F.coalesce(inner, F.when(is_text, F.try_variant_get(obj, f"$.{path}", "string")))


def json_ld_candidates(products: DataFrame, key: str = "page_id") -> DataFrame:
    """Name, maker, or else brand as a weak maker. A price on offer is never an MRP."""
    p = products.select(key, F.try_variant_get("obj", "$.name", "string").alias("name"), _text_or_name("obj", "manufacturer").alias("maker"), _text_or_name("obj", "brand").alias("brand"))
    row = lambda f, v, c, o: F.struct(F.lit(f).alias("field_name"), v.alias("field_value"), F.lit(c).alias("confidence"), F.lit(o).alias("ord"))
    rows = F.array(row("product_name", F.col("name"), 0.95, 0), F.when(F.col("maker").isNotNull(), row("manufacturer_name", F.col("maker"), 0.85, 1)).otherwise(row("manufacturer_name", F.col("brand"), 0.3, 1)))
    return p.select(key, F.inline(rows)).filter("field_value IS NOT NULL AND trim(field_value) <> ''")


def open_graph(parts: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, prop, content): og properties with content; the last of a name counts."""
    m = parts.filter("part = 'meta' AND k1 LIKE 'og:%' AND k2 <> ''")
    return m.groupBy(key, F.col("k1").alias("prop")).agg(F.max_by("k2", "ord").alias("content"))


def visible_text(parts: DataFrame, key: str = "page_id", most: int | None = 20_000) -> DataFrame:
    """(key, text): the first `most` characters, the reference's bound, or with None the whole text."""
    t = F.regexp_replace(F.regexp_replace("text", r"[\s\p{Z}]+", " "), r"(\| ?){2,}", "| ")
    return parts.filter("part = 'text'").select(key, (t if most is None else F.substring(t, 1, most)).alias("text"))


def page_images(parts: DataFrame, products: DataFrame, key: str = "page_id", most: int = 8) -> DataFrame:
    """(key, urls): JSON-LD images, then og:image, then img tags (the first 16), each once, at most `most`."""
    img = F.coalesce(F.try_variant_get("obj", "$.image", "array<string>"), F.array(F.try_variant_get("obj", "$.image", "string")))
    ld = products.select(key, img.alias("ld"))
    og = open_graph(parts, key).filter("prop = 'og:image'").select(key, F.array("content").alias("og"))
    tags = parts.filter("part = 'img'").groupBy(key).agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), 1, 16).alias("tags"))
    none = F.array().cast("array<string>")
    j = parts.select(key).distinct().join(ld, key, "left").join(og, key, "left").join(tags, key, "left")
    every = F.filter(F.concat(*[F.coalesce(c, none) for c in ("ld", "og", "tags")]), lambda u: u.isNotNull() & (u != ""))
    return j.select(key, F.slice(F.array_distinct(every), 1, most).alias("urls"))


def table_pairs(parts: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, ord, label, value): rows of two filled cells, from tables with at least two such rows that make up 60 % of
    all their rows."""
    row = F.when(F.col("k2").isNotNull(), F.struct("ord", F.col("k2").alias("label"), F.col("text").alias("value")))
    box = parts.filter("part = 'row'").groupBy(key, "k1").agg(F.collect_list(row).alias("pairs"), F.count("*").alias("n"))
    return box.filter((F.size("pairs") >= 2) & (F.size("pairs") >= 0.6 * F.col("n"))).select(key, F.inline("pairs"))


def bullet_pairs(parts: DataFrame, key: str = "page_id") -> DataFrame:
    """Bullets `label : value` and grids of exactly two filled children."""
    good = parts.filter("part = 'bullet' OR part = 'grid' AND length(k1) <= 60")
    return good.select(key, "ord", F.col("k1").alias("label"), F.col("text").alias("value"))


def label_candidates(pairs: DataFrame, key: str = "page_id") -> DataFrame:
    """Pairs whose label is exactly a known one; broadcast of the 23-row vocabulary."""
    known = pairs.sparkSession.createDataFrame(list(LABELS.items()), "label_key string, field_name string")
    p = pairs.withColumn("label_key", F.lower(F.trim("label"))).filter("value <> ''")
    return p.join(F.broadcast(known), "label_key").select(key, "ord", "field_name", F.col("value").alias("field_value"), F.lit(0.75).alias("confidence"), F.lit("CSS_SELECTOR").alias("strategy"))


def open_graph_candidates(parts: DataFrame, key: str = "page_id") -> DataFrame:
    """The og:title as a product name."""
    og = open_graph(parts, key).filter("prop = 'og:title'")
    return og.select(key, F.lit(0).alias("ord"), F.lit("product_name").alias("field_name"), F.col("content").alias("field_value"), F.lit(0.6).alias("confidence"))


def selector_hits(parts: DataFrame, key: str = "page_id") -> DataFrame:
    """What the platform's selectors find, one value for each field."""
    return parts.filter("part = 'sel'").select(key, "ord", F.col("k1").alias("field_name"), F.col("text").alias("field_value"), F.col("k2").cast("double").alias("confidence"))


def platform_pairs(parts: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, ord, label, value) from the places where the platform keeps them."""
    return parts.filter("part = 'pair'").select(key, "ord", F.col("k1").alias("label"), F.col("text").alias("value"))


def page_candidates(parts: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, ord, field_name, field_value, confidence, strategy): the candidates of all strategies. The order of the
    strategies, which breaks ties, is JSON-LD, OpenGraph, text, selectors, labels. parts is read once for each
    strategy: persist it, or write it as a table, first."""
    text = visible_text(parts, key, most=None).select(key, F.inline(candidates(F.col("text")))).filter(not_blank(F.col("field_value")))
    each = (
        ("JSON_LD", json_ld_candidates(json_ld_products(parts, key), key)),
        ("OPEN_GRAPH", open_graph_candidates(parts, key)),
        ("FALLBACK_TEXT", text),
        ("CSS_SELECTOR", selector_hits(parts, key)),
        ("CSS_SELECTOR", label_candidates(platform_pairs(parts, key), key).drop("strategy")),
    )
    cols = lambda rank: [key, (F.lit(rank * 100_000_000) + F.col("ord")).cast("long").alias("ord"), "field_name", "field_value", F.col("confidence").cast("double").alias("confidence")]
    return reduce(DataFrame.unionByName, [df.select(*cols(rank), F.lit(name).alias("strategy")) for rank, (name, df) in enumerate(each)])


def product_record(parts: DataFrame, products: DataFrame, key: str = "page_id") -> DataFrame:
    """Title (that of a platform whose own one wins, og, JSON-LD, that of other platforms, then <title>), description, brand, and the first offer's price and currency."""
    og = open_graph(parts, key).groupBy(key).pivot("prop", ["og:title", "og:description"]).agg(F.first("content"))
    og = og.select(key, F.col("`og:title`").alias("og_title"), F.col("`og:description`").alias("og_desc"))
    first = parts.groupBy(key).agg(
        F.min_by(F.when(F.col("part") == "title", F.col("text")), F.when(F.col("part") == "title", F.col("ord"))).alias("page_title"),
        F.min_by(F.when(F.col("k1") == "description", F.col("k2")), F.when((F.col("part") == "meta") & (F.col("k1") == "description"), F.col("ord"))).alias("page_desc"),
        F.max(F.when((F.col("part") == "headline") & (F.col("k1") == "wins"), F.col("text"))).alias("own_title"),
        F.max(F.when((F.col("part") == "headline") & (F.col("k1") == "fills"), F.col("text"))).alias("fill_title"),
    )
    offer = F.coalesce(F.try_variant_get("obj", "$.offers[0]", "variant"), F.try_variant_get("obj", "$.offers", "variant"))
    ld = products.select(
        key, F.try_variant_get("obj", "$.name", "string").alias("ld_title"), F.try_variant_get("obj", "$.description", "string").alias("ld_desc"), _text_or_name("obj", "brand").alias("brand"),
        F.try_variant_get(offer, "$.price", "string").try_cast("decimal(12,2)").alias("listed_price"), F.try_variant_get(offer, "$.priceCurrency", "string").alias("currency"),
    )
    j = first.join(og, key, "left").join(ld, key, "left")
    some = lambda *cs: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs])
    return j.select(key, some("own_title", "og_title", "ld_title", "fill_title", "page_title").alias("title"), some("og_desc", "ld_desc", "page_desc").alias("description"), "brand", "listed_price", "currency")
