"""Queries of intake, scalar functions, products, versions and events over the given tables."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packlens.functions import patterns
from packlens.functions import text as X
from packlens.functions.fuzzy import token_sort_ratio, with_dates
from packlens.operators import context, declare, intake, ocr, products, report, versioning
from packlens.plans import captures
from packlens.plans.oracle import LST
from packlens.plans.synth import listings
from packlens.session import table
from packlens.sources import html_parts as H

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


@query(r"""SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}')) AS email FROM documents""")
def document_emails(spark, sf_dir):
    """C13 for e-mail addresses, over whole documents."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.explode(F.transform(patterns.pattern_candidates(F.col("text"), "consumer_care_email"), lambda c: c["field_value"])).alias("email"))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, 'Rs. ' || printf('%.2f', l_extendedprice) AS price, CASE l_linenumber % 5 WHEN 0 THEN 'kg' WHEN 1 THEN 'g' WHEN 2 THEN 'ml' WHEN 3 THEN 'l' ELSE 'pcs' END AS u,
    CAST(l_quantity AS BIGINT) AS n FROM lineitem)
    SELECT l_orderkey, l_linenumber, replace(price, 'Rs. ', '') AS currency, CASE u WHEN 'kg' THEN (n * 1000) || 'g' WHEN 'g' THEN n || 'g' WHEN 'ml' THEN n || 'ml' WHEN 'l' THEN (n * 1000) || 'ml' END AS quantity,
    n BETWEEN 10 AND 20 AS in_range, 'Item ' || n AS label FROM v""")
def normalized_values(spark, sf_dir):
    """F1-F4, F6, F8, F14 on values written as text."""
    li = table(spark, sf_dir, "lineitem")
    unit = F.element_at(F.array(*[F.lit(u) for u in ("kg", "g", "ml", "l", "pcs")]), (F.col("l_linenumber") % 5 + 1).cast("int"))
    qty = F.concat(F.col("l_quantity").cast("bigint").cast("string"), F.lit(" "), unit)
    price = F.format_string("Rs. %.2f", "l_extendedprice")
    return li.select(
        "l_orderkey", "l_linenumber", X.normalize_value(F.lit("mrp"), price).alias("currency"), X.normalize_value(F.lit("net_quantity"), qty).alias("quantity"),
        X.number_between(qty, 10, 20).alias("in_range"), X.normalize_text(F.concat(F.lit("  Item \t"), F.col("l_quantity").cast("bigint").cast("string"), F.lit(" \n"))).alias("label"),
    )


@query("""SELECT o_orderkey, CASE WHEN k < 7 THEN strftime(CASE k WHEN 4 THEN date_trunc('month', o_orderdate) ELSE o_orderdate END, '%Y-%m-%d') END AS iso, k < 7 AS looks FROM (SELECT *, o_orderkey % 9 AS k FROM orders)""")
def normalized_dates(spark, sf_dir):
    """dates in listed forms, in others that the second tier reads, and texts without any."""
    forms = ("yyyy-MM-dd", "d/M/yyyy", "d.M.yyyy", "d MMM yyyy", "MMMM yyyy", "'packed on the 'd' of 'MMMM', 'yyyy' at noon'", "EEEE' 'd'-'MMM'-'yyyy")
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 9
    text = F.coalesce(*[F.when(k == i, F.date_format("o_orderdate", f)) for i, f in enumerate(forms)], F.when(k == 7, "best when fresh"))
    dated = with_dates(o.select("o_orderkey", text.alias("text")), "text", "iso", "2024-05-01")
    return dated.select("o_orderkey", "iso", (X.looks_like_date(F.col("text")) | F.col("iso").isNotNull()).alias("looks"))


@query("""WITH t AS (SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS n, length(CAST(p_partkey AS VARCHAR)) AS L, 'Item ' || p_partkey || ' 😀 | MRP: Rs. ' || p_partkey || '.50 | शुद्ध मात्रा: ' || p_partkey || ' ग्राम | Packed by: Box ' || p_partkey || ', Pune 411001 | thank you, come again, all of you and your friends' AS s FROM part),
    m AS (SELECT *, length(f) AS w, strpos(s, f) - 1 AS a FROM (SELECT *, 'mrp' AS field_name, n || '.50' AS field_value, 'MRP: Rs. ' || n || '.50' AS f FROM t UNION ALL SELECT *, 'net_quantity', n || ' ग्राम', 'शुद्ध मात्रा: ' || n || ' ग्राम' FROM t
      UNION ALL SELECT *, 'packer_name', 'Box ' || n, 'Packed by: Box ' || n FROM t UNION ALL SELECT *, 'packer_address', 'Pune 411001', 'Packed by: Box ' || n FROM t))
    SELECT p_partkey, field_name, field_value, a AS start_at, a + w AS end_at, trim(substr(s, greatest(a - 20, 0) + 1, a + w + CASE field_name WHEN 'packer_address' THEN 220 ELSE 20 END - greatest(a - 20, 0))) AS snippet FROM m""")
def declaration_snippets(spark, sf_dir):
    """What stands around every match, English and Hindi, with its place in code points."""
    n = F.col("p_partkey").cast("string")
    t = F.concat(F.lit("Item "), n, F.lit(" 😀 | MRP: Rs. "), n, F.lit(".50 | शुद्ध मात्रा: "), n, F.lit(" ग्राम | Packed by: Box "), n, F.lit(", Pune 411001 | thank you, come again, all of you and your friends"))
    # dealt out first: the table's few splits are small, the search in its texts is long
    rows = table(spark, sf_dir, "part").repartition("p_partkey").select("p_partkey", F.inline(patterns.located(t)))
    return rows.select("p_partkey", "field_name", "field_value", F.col("start_at").cast("bigint").alias("start_at"), F.col("end_at").cast("bigint").alias("end_at"), "snippet")


@query("SELECT page_id, sha256(lower(trim(url))) AS url_hash, sha256(html) AS page_hash FROM pages")
def page_hashes(spark, sf_dir):
    """F9."""
    return table(spark, sf_dir, "pages").select("page_id", X.url_hash(F.col("url")).alias("url_hash"), X.page_hash(F.col("html")).alias("page_hash"))


@query("""SELECT s_suppkey, s_suppkey % 3 <> 0 AS has_pin, s_suppkey % 2 = 0 AS has_locality, s_suppkey % 7 = 0 AS tobacco, s_suppkey % 5 = 0 AS institutional, 'Net Quantity' AS label FROM supplier""")
def text_predicates(spark, sf_dir):
    """F11-F13, P7 on addresses made from suppliers."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    addr = F.concat(F.when(k % 2 == 0, "Hill Road, Pune ").otherwise("Plot 7 "), F.when(k % 3 != 0, "411001").otherwise("41100"), F.when(k % 7 == 0, " Cigar shop").otherwise(""), F.when(k % 5 == 0, " not for retail sale").otherwise(""))
    return s.select("s_suppkey", addr.rlike(X.PIN).alias("has_pin"), addr.rlike(X.LOCALITY).alias("has_locality"), X.is_tobacco(addr).alias("tobacco"), X.is_institutional(addr).alias("institutional"), X.display_label(F.lit("net_quantity"), {"mrp": "MRP"}).alias("label"))


@query("""SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, count(*) AS n, count(*) FILTER (url LIKE 'https:%') AS n_https FROM pages GROUP BY 1""")
def page_hosts(spark, sf_dir):
    """P2's host, S1."""
    p = table(spark, sf_dir, "pages")
    return p.groupBy(intake.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"), F.count_if(F.col("url").startswith("https:")).alias("n_https"))


@query("""SELECT CASE WHEN p_partkey % 11 = 0 THEN 'BLOCKED_BY_ROBOTS' WHEN p_partkey % 13 = 0 THEN 'FAILED' WHEN p_partkey % 6 = 1 THEN 'ACCESS_DENIED' WHEN p_partkey % 6 = 2 THEN 'FAILED'
    WHEN p_partkey % 6 = 3 THEN 'TIMEOUT' ELSE 'SUCCESS' END AS fetch_status, count(*) AS n FROM part GROUP BY 1""")
def fetch_outcomes(spark, sf_dir):
    """P3."""
    k = F.col("p_partkey")
    robots = F.when(k % 11 == 0, False).when(k % 13 == 0, None).otherwise(True)
    code = F.when(k % 6 == 1, 403).when(k % 6 == 2, 500).when(k % 6 != 3, 200)
    error = F.when(k % 6 == 3, "Timeout 30000ms exceeded")
    return table(spark, sf_dir, "part").groupBy(intake.fetch_status(robots, code, error).alias("fetch_status")).agg(F.count("*").alias("n"))


_IP = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"
_BLOCKS = ", ".join(f"('{b}')" for b in intake.RESERVED)


@query(rf"""WITH b AS (SELECT block, split_part(block, '/', 1) AS net, CAST(split_part(block, '/', 2) AS INT) AS bits FROM (VALUES {_BLOCKS}) t(block)),
    r AS (SELECT block, ((CAST(split_part(net, '.', 1) AS BIGINT) * 256 + CAST(split_part(net, '.', 2) AS BIGINT)) * 256 + CAST(split_part(net, '.', 3) AS BIGINT)) * 256 + CAST(split_part(net, '.', 4) AS BIGINT) AS lo, bits FROM b),
    x AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_IP}')) AS ip FROM documents),
    n AS (SELECT doc_id, ip, CAST(split_part(ip, '.', 1) AS BIGINT) a, CAST(split_part(ip, '.', 2) AS BIGINT) b, CAST(split_part(ip, '.', 3) AS BIGINT) c, CAST(split_part(ip, '.', 4) AS BIGINT) d FROM x)
    SELECT doc_id, ip, block FROM n JOIN r ON greatest(a, b, c, d) <= 255 AND ((a * 256 + b) * 256 + c) * 256 + d BETWEEN lo AND lo + CAST(pow(2, 32 - bits) AS BIGINT) - 1""")
def reserved_addresses(spark, sf_dir):
    """A range join of the addresses in documents with the reserved blocks."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_IP), F.lit(0))).alias("ip"))
    return intake.in_reserved(d, "ip").select("doc_id", "ip", "block")


@query("""WITH u AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages), a AS (SELECT DISTINCT host, length(host) % 3 AS m FROM u)
    SELECT page_id, host FROM u JOIN a USING (host) WHERE m = 1""")
def safe_page_urls(spark, sf_dir):
    """Hosts with a private answer or none are left out."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    h = p.select(intake.host(F.col("url")).alias("host")).distinct().withColumn("m", F.length("host") % 3)
    answers = h.filter("m > 0").select("host", F.when(F.col("m") == 1, "93.184.216.34").otherwise("10.1.2.3").alias("ip"))
    return intake.safe_urls(p, answers).select("page_id", "host")


@query("""WITH u AS (SELECT page_id % 3 AS batch_id, page_id * 2 AS pos, url FROM pages UNION ALL SELECT page_id % 3, page_id * 2 + 1, CASE page_id % 5 WHEN 0 THEN 'http:/' WHEN 1 THEN ' ' || url || ' ' ELSE url || '&v=' || page_id END FROM pages),
    t AS (SELECT batch_id, pos, trim(url) AS url, length(trim(url)) >= 8 AS ok FROM u), f AS (SELECT batch_id, url, min(pos) AS first FROM t WHERE ok GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY first) AS nth FROM f)
    SELECT CAST(t.batch_id AS BIGINT) AS batch_id, t.pos, CASE WHEN NOT ok THEN 'too short' WHEN nth > 50 THEN 'over limit' WHEN t.pos > first THEN 'duplicate' ELSE 'accepted' END AS decision FROM t LEFT JOIN r ON r.batch_id = t.batch_id AND r.url = t.url""")
def accepted_urls(spark, sf_dir):
    """Batches of page URLs with short and repeated copies."""
    p, k = table(spark, sf_dir, "pages"), F.col("page_id")
    again = F.when(k % 5 == 0, "http:/").when(k % 5 == 1, F.concat(F.lit(" "), "url", F.lit(" "))).otherwise(F.concat("url", F.lit("&v="), k.cast("string")))
    u = p.select((k % 3).alias("batch_id"), (k * 2).alias("pos"), "url").union(p.select(k % 3, k * 2 + 1, again))
    return intake.accept_urls(u).select("batch_id", "pos", "decision")


@query("""SELECT o_orderkey, o_orderkey % 4 <> 3 AND o_orderkey % 20 <= 15 AS ok FROM orders""")
def accepted_uploads(spark, sf_dir):
    """P9."""
    k = F.col("o_orderkey")
    path = F.concat(F.lit("f"), k.cast("string"), F.element_at(F.array(*[F.lit(x) for x in (".PNG", ".pdf", "", ".exe")]), (k % 4 + 1).cast("int")))
    return table(spark, sf_dir, "orders").select("o_orderkey", intake.upload_ok(path, k % 20 * 1024 * 1024, F.lit("image/webp")).alias("ok"))


@query("""SELECT c_mktsegment AS rule_key, regexp_matches(c_mktsegment, '^[A-Z0-9]+(-[A-Z0-9]+)*$') AS valid, count(*) AS n FROM customer GROUP BY ALL""")
def rule_key_formats(spark, sf_dir):
    """P10."""
    return table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("rule_key"), intake.valid_rule_key(F.col("c_mktsegment")).alias("valid")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT o_orderkey AS check_id, CASE o_orderstatus WHEN 'P' THEN 'POTENTIAL_NON_COMPLIANCE' WHEN 'O' THEN 'PASS' ELSE 'NEEDS_MANUAL_REVIEW' END AS status FROM orders)
    SELECT status, count(*) AS n FROM c WHERE status = 'POTENTIAL_NON_COMPLIANCE' AND check_id % 3 <> 0 GROUP BY 1""")
def review_backlog(spark, sf_dir):
    """J5, A19."""
    o = table(spark, sf_dir, "orders")
    c = o.select(F.col("o_orderkey").alias("check_id"), F.when(F.col("o_orderstatus") == "P", "POTENTIAL_NON_COMPLIANCE").when(F.col("o_orderstatus") == "O", "PASS").otherwise("NEEDS_MANUAL_REVIEW").alias("status"))
    left = report.review_backlog(c, c.filter("check_id % 3 = 0"))
    return left.groupBy("status").agg(F.count_distinct("check_id").alias("n"))


@query("""SELECT o_orderkey AS check_id, o_orderstatus AS status, CASE WHEN o_orderkey % 4 = 0 THEN 'PASS' ELSE o_orderstatus END AS final_status FROM orders""")
def reviewed_checks(spark, sf_dir):
    """Reviews count only for checks of their inspection; the last one decides."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("check_id"), F.col("o_custkey").alias("inspection_id"), F.col("o_orderstatus").alias("status"), "o_orderdate")
    first = o.filter("check_id % 4 = 0").select("check_id", "inspection_id", F.lit("NEEDS_MANUAL_REVIEW").alias("final_status"), F.col("o_orderdate").alias("created_at"))
    last = o.filter("check_id % 4 = 0").select("check_id", "inspection_id", F.lit("PASS").alias("final_status"), F.timestamp_add("DAY", F.lit(1), F.col("o_orderdate")).alias("created_at"))
    alien = o.filter("check_id % 4 = 1").select("check_id", (F.col("inspection_id") + 1).alias("inspection_id"), F.lit("PASS").alias("final_status"), F.col("o_orderdate").alias("created_at"))
    return report.reviewed_status(o, first.union(last).union(alien)).select("check_id", "status", "final_status")


@query("""SELECT user_id AS inspection_id, arg_max(CAST(floor(value * 10 + 0.001) AS INT), (ts, event_id)) AS duration_ms FROM events WHERE event_type = 'purchase' AND event_id % 3 <> 0 GROUP BY 1""")
def run_durations(spark, sf_dir):
    """The last finished run's duration."""
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("inspection_id"), "event_id", F.col("ts").alias("created_at"), F.when(F.col("event_type") == "purchase", "DONE").otherwise("SCRAPE").alias("stage"),
        F.when(F.col("event_id") % 3 != 0, F.floor(F.col("value") * 10 + 0.001).cast("int")).alias("duration_ms"),
    )
    return report.run_duration(e)


@query("""SELECT event_type AS stage, count(*) AS n, CAST(sum(event_id % 1000) AS BIGINT) AS total_ms, CAST(max(event_id % 1000) AS BIGINT) AS max_ms FROM events WHERE event_id % 3 <> 0 GROUP BY 1""")
def stage_durations(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 1000).alias("duration_ms"))
    return report.stage_durations(e)


@query("""SELECT l_orderkey AS inspection_id, count(*) AS n_images, count(*) FILTER (l_returnflag = 'N') AS n_acceptable, count(*) FILTER (l_returnflag = 'N') / count(*) AS ratio FROM lineitem GROUP BY 1""")
def image_acceptance(spark, sf_dir):
    """A21."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("inspection_id"), (F.col("l_returnflag") == "N").alias("quality_acceptable"))
    return report.acceptance_ratio(li)


@query("""SELECT o_orderkey AS image_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def images_without_ocr(spark, sf_dir):
    """J12."""
    done = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("image_id"))
    return ocr.without_boxes(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id")), done)


@query("""SELECT l_orderkey AS image_id, count(*) FILTER (l_linenumber % 4 <> 0) AS n, floor(sum(CASE WHEN l_linenumber % 4 = 0 THEN 0 WHEN l_linenumber % 3 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) END)) AS conf_sum FROM lineitem GROUP BY 1 HAVING n > 0""")
def ocr_rows(spark, sf_dir):
    """Blank words go, negative and unreadable confidences are 0."""
    li = table(spark, sf_dir, "lineitem")
    raw = li.select(F.col("l_orderkey").alias("image_id"), F.when(F.col("l_linenumber") % 4 == 0, "  ").otherwise("word").alias("text"), F.when(F.col("l_linenumber") % 3 == 0, "-1").otherwise(F.col("l_quantity").cast("string")).alias("conf"))
    from packlens.operators.ocr import clean_boxes

    return clean_boxes(raw).groupBy("image_id").agg(F.count("*").alias("n"), F.floor(F.sum(F.col("confidence") * 100) + 0.001).cast("double").alias("conf_sum"))


@query("""WITH old AS (SELECT sha256('https://x.example/' || p_partkey) AS url_hash, p_name AS title, p_brand AS brand FROM part WHERE p_partkey % 3 <> 0),
    cap AS (SELECT p_partkey AS k, 'https://x.example/' || p_partkey AS url, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'new ' || p_name END AS title FROM part WHERE p_partkey % 2 = 0)
    SELECT coalesce(o.url_hash, sha256(c.url)) AS url_hash, coalesce(nullif(c.title, ''), o.title) AS title, o.brand, 'INR' AS currency FROM old o FULL JOIN cap c ON o.url_hash = sha256(c.url)""")
def product_upsert(spark, sf_dir):
    """J10."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    url = F.concat(F.lit("https://x.example/"), k.cast("string"))
    none = F.lit(None).cast("string")
    at = F.lit("2024-01-01").cast("timestamp")
    old = p.filter(k % 3 != 0).select(X.url_hash(url).alias("url_hash"), url.alias("canonical_url"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), none.alias("description"), F.lit(None).cast("decimal(12,2)").alias("listed_price"), F.lit("INR").alias("currency"), at.alias("last_checked_at"))
    new = lambda title, days: p.filter(k % 2 == 0).select(url.alias("url"), title.alias("title"), none.alias("brand"), none.alias("description"), F.lit(None).cast("decimal(12,2)").alias("listed_price"), none.alias("currency"), F.timestamp_add("DAY", F.lit(days), at).alias("fetched_at"))
    caps = new(F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("old "), "p_name")), 1).union(new(F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("new "), "p_name")), 2)).union(new(none, 3))
    return products.upsert(old, caps).select("url_hash", "title", "brand", "currency")


@query(f"""WITH {LST}, n AS (SELECT product_id, arg_max('name ' || k, k) AS best_name FROM lst GROUP BY 1) SELECT inspection_id, concat_ws(' ', title, brand, best_name, CASE WHEN n_images > 0 THEN 'img a img b' END) AS class_text FROM lst JOIN n USING (product_id)""")
def classification_texts(spark, sf_dir):
    """A9."""
    lst = listings(spark, sf_dir)
    names = lst.select("product_id", "inspection_id", F.concat(F.lit("name "), F.col("k").cast("string")).alias("field_value"), F.col("k").cast("double").alias("confidence"))
    ocr = lst.filter("n_images > 0").select("inspection_id", F.explode(F.array(*[F.struct(F.lit(i).alias("image_id"), F.lit(f"img {c}").alias("text")) for i, c in ((2, "b"), (1, "a"))])).alias("t")).select("inspection_id", "t.*")
    return products.classification_text(lst.withColumn("description", F.lit(None).cast("string")), names, ocr).select("inspection_id", "class_text")


_STORE = """s AS (SELECT 'R-' || p_partkey AS rule_key, p_partkey AS k, p_partkey % 5 <> 0 AS active, 1 + p_partkey % 3 AS v FROM part WHERE p_partkey % 6 <> 0),
    i AS (SELECT 'R-' || p_partkey AS rule_key, p_partkey % 4 = 0 AS changed FROM part WHERE p_partkey % 7 <> 0),
    pl AS (SELECT coalesce(s.rule_key, i.rule_key) AS rule_key, CASE WHEN s.rule_key IS NULL THEN 'created' WHEN i.rule_key IS NULL THEN CASE WHEN active THEN 'deactivated' END
      WHEN NOT active THEN 'reactivated' WHEN changed THEN 'new_version' ELSE 'unchanged' END AS action, s.v, s.active, coalesce(i.changed, FALSE) AS changed FROM s FULL JOIN i USING (rule_key))"""


def _store(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    key = F.concat(F.lit("R-"), k.cast("string"))
    plain = {c: F.concat(F.lit(c), F.lit(" of "), "p_name") for c in versioning.CONTENT}
    plain |= {"validator_config": F.lit(None).cast("string"), "gating_only": F.lit(None).cast("boolean"), "effective_from": F.lit(None).cast("date"), "effective_until": F.lit(None).cast("date")}
    plain |= {c: F.lit(None).cast("array<string>") for c in ("applicable_categories", "excluded_categories")}
    other = {c: F.concat(v, F.lit("!")) for c, v in plain.items()}
    other |= {"validator_config": F.lit('{"min": 1}'), "gating_only": F.lit(True), "effective_from": F.lit("2024-01-01").cast("date"), "effective_until": F.lit("2024-12-31").cast("date")}
    other |= {c: F.array(F.lit("food")) for c in ("applicable_categories", "excluded_categories")}
    turn = (k / 4).cast("int") % len(plain)  # every fourth rule changes in one field, each field in turn
    changed = [F.when((k % 4 == 0) & (turn == i), other[c]).otherwise(plain[c]).alias(c) for i, c in enumerate(plain)]
    body = [v.alias(c) for c, v in plain.items()]
    store = versioning.with_hash(p.filter(k % 6 != 0).select(key.alias("rule_key"), (k % 5 != 0).alias("active"), (1 + k % 3).cast("int").alias("version_number"), F.lit(True).alias("is_current"), *body))
    new = versioning.with_hash(p.filter(k % 7 != 0).select(key.alias("rule_key"), *changed))
    return store, new


@query(f"WITH {_STORE} SELECT rule_key, action FROM pl WHERE action IS NOT NULL")
def rule_load_plan(spark, sf_dir):
    """V1, V2, U2."""
    return versioning.plan_load(*_store(spark, sf_dir)).select("rule_key", "action")


@query(f"""WITH {_STORE}, kept AS (SELECT rule_key, v AS version_number, NOT (coalesce(action, '') IN ('new_version', 'reactivated') AND changed) AS is_current,
      CASE action WHEN 'deactivated' THEN FALSE WHEN 'reactivated' THEN TRUE ELSE active END AS active FROM pl WHERE v IS NOT NULL)
    SELECT rule_key, CAST(version_number AS INT) AS version_number, is_current, active FROM kept UNION ALL SELECT rule_key, CAST(coalesce(v, 0) + 1 AS INT), TRUE, TRUE FROM pl WHERE action = 'created' OR (action IN ('new_version', 'reactivated') AND changed)""")
def rule_load_applied(spark, sf_dir):
    """V3, W8."""
    return versioning.apply_load(*_store(spark, sf_dir)).select("rule_key", "version_number", "is_current", "active")


#: Six loads of rule sets, one a year, with a rule for each part: which rules a load has, and what they say, goes by key and load.
_HISTORY = """l AS (SELECT p_partkey AS n, i, 'N' || p_partkey AS rule_key, (p_partkey + i // 2) % 3 AS h FROM part, range(1, 7) r(i) WHERE (p_partkey + i) % 5 <> 0),
    c AS (SELECT *, coalesce(h <> lag(h) OVER w, TRUE) AS changed, coalesce(i - lag(i) OVER w > 1, FALSE) AS gap FROM l WINDOW w AS (PARTITION BY n ORDER BY i)),
    v AS (SELECT *, sum(CASE WHEN changed THEN 1 ELSE 0 END) OVER w AS v, sum(CASE WHEN changed OR gap THEN 1 ELSE 0 END) OVER w AS run FROM c WINDOW w AS (PARTITION BY n ORDER BY i ROWS UNBOUNDED PRECEDING)),
    hist AS (SELECT n, rule_key, CAST(v AS INT) AS version_number, make_date(1991 + min(i), 7, 1) AS valid_from, CASE WHEN max(i) < 6 THEN make_date(1992 + max(i), 7, 1) END AS valid_until FROM v GROUP BY n, rule_key, v, run)"""


def _loads(spark, sf_dir):
    k, i = F.col("p_partkey"), F.col("i")
    rows = table(spark, sf_dir, "part").select(k, F.explode(F.sequence(F.lit(1), F.lit(6))).alias("i")).filter((k + i) % 5 != 0)
    n = k.cast("string")
    said = F.sha2(((k + (i / 2).cast("int")) % 3).cast("string"), 256)
    return rows.select(F.concat(F.lit("N"), n).alias("rule_key"), F.make_date(i + 1991, F.lit(7), F.lit(1)).alias("loaded_at"), said.alias("content_hash"),
                       F.concat(F.lit("Ref "), n).alias("rule_reference"), F.concat(F.lit("Doc "), (k % 3).cast("string")).alias("source_document"), F.concat(F.lit("Rule "), n).alias("source_locator"))


@query(f"WITH {_HISTORY} SELECT rule_key, version_number, valid_from, valid_until, row_number() OVER (PARTITION BY n ORDER BY valid_from) AS place FROM hist")
def rule_history(spark, sf_dir):
    """The ordered history of every rule over six loads, with the times in which each version was valid."""
    h = versioning.history(_loads(spark, sf_dir)).select("rule_key", "version_number", "valid_from", "valid_until")
    return h.withColumn("place", F.row_number().over(Window.partitionBy("rule_key").orderBy("valid_from")))


@query(f"""WITH {_HISTORY}, o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, unnest([1, 2, 3, 4]) AS j FROM orders), x AS (SELECT DISTINCT o_orderkey, d, 1 + (o_orderkey * j * 7 + j) % 40 AS n FROM o),
    y AS (SELECT o_orderkey, h.n, h.rule_key, h.version_number FROM x JOIN hist h ON h.n = x.n AND d >= valid_from AND (valid_until IS NULL OR d < valid_until)),
    f AS (SELECT *, min(rule_key) OVER (PARTITION BY o_orderkey, n % 3) AS first FROM y), z AS (SELECT *, dense_rank() OVER (PARTITION BY o_orderkey ORDER BY first) AS place FROM f)
    SELECT o_orderkey, '{{"rules":[' || string_agg('{{"rule_key":"' || rule_key || '","version_number":' || version_number || ',"rule_reference":"Ref ' || n || '","source_document":"Doc ' || n % 3 || '","source_index":' || place || ',"source_locator":"Rule ' || n || '"}}', ',' ORDER BY rule_key) || ']}}' AS snapshot
    FROM z GROUP BY 1""")
def report_rule_versions(spark, sf_dir):
    """Reports, one an order, with the rule versions that were valid on their day."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), F.explode(F.array(*[F.lit(j) for j in (1, 2, 3, 4)])).alias("j"))
    used = o.select("o_orderkey", "day", F.concat(F.lit("N"), (1 + (F.col("o_orderkey") * F.col("j") * 7 + F.col("j")) % 40).cast("string")).alias("rule_key")).distinct()
    return report.versioned_snapshot(versioning.as_of(used, versioning.history(_loads(spark, sf_dir)), "day"), "o_orderkey")


@query("""SELECT 'p' || p_partkey AS inspection_id, 'new' AS field_value FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 'p' || p_partkey, 'derived' FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 4 <> 1
    UNION ALL SELECT 'p' || p_partkey, 'typed' FROM part WHERE p_partkey % 4 = 1""")
def rerun_replaces(spark, sf_dir):
    """A re-run replaces derived rows and keeps what users entered."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    iid = F.concat(F.lit("p"), k.cast("string")).alias("inspection_id")
    kind = lambda t: F.lit(t).alias("source_type")
    typed = declare.manual_declarations(p.filter(k % 4 == 1).select(iid, F.lit("typed").alias("field_value"))).select("inspection_id", "field_value", "source_type")
    old = p.filter((k % 3 == 0) | (k % 4 != 1)).select(iid, F.lit("derived").alias("field_value"), kind("WEBPAGE_TEXT")).unionByName(typed)
    new = p.filter(k % 3 == 0).select(iid, F.lit("new").alias("field_value"), kind("WEBPAGE_TEXT"))
    return declare.replace_derived(old, new).select("inspection_id", "field_value")


#: HTML knows these entities with or without their semicolon.
@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&(lt|LT);?', '<', 'g'), '&(gt|GT);?', '>', 'g'),
    '&(quot|QUOT);?', '"', 'g'), '&#39(;|$|([^0-9]))', '''\2', 'g'), '&(amp|AMP);?', '&', 'g'), '\s+', ' ', 'g')) AS title FROM pages""")
def page_titles(spark, sf_dir):
    """C5, by the one HTML pass."""
    parts = H.html_parts(table(spark, sf_dir, "pages"))
    return parts.filter("part = 'title'").groupBy("page_id").agg(F.min_by("text", "ord").alias("title"))


@query()
def page_texts(spark, sf_dir):
    """C6, of whole pages."""
    t = H.visible_text(H.html_parts(table(spark, sf_dir, "pages")), most=None)
    return t.select("page_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_hash"))


@query()
def page_records(spark, sf_dir):
    """A product record of every page."""
    parts = H.html_parts(table(spark, sf_dir, "pages"))
    return H.product_record(parts, H.json_ld_products(parts))


@query()
def page_image_lists(spark, sf_dir):
    """C7."""
    parts = H.html_parts(table(spark, sf_dir, "pages"))
    return H.page_images(parts, H.json_ld_products(parts))


def _blocks(spark, sf_dir):
    """Every page with blocks behind its own HTML that show declarations as shops do, by page_id % 8; the URLs of the last
    four are those of the platforms."""
    k, n = F.col("page_id") % 8, F.col("page_id").cast("string")
    t = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    td = lambda a, b: t("<tr><th>", a, "</th><td>", b, "</td></tr>")
    forms = [
        t("<table><tbody>", td("Net Quantity", t(n, " g")), td("Packed By", t("Packer ", n)), td("lone", ""), "</tbody></table>"),
        t("<ul><li><b>Country of Origin ‏ : ‎</b> Nepal</li><li>Is Discontinued By Manufacturer : No</li><li>Best Before: ", n, " days</li></ul>"),
        t("<div><span>Manufacturer</span><span>Maker ", n, "</span><i> </i></div>"),
        t("<table>", td("Net Quantity", "1 g"), "</table><table>", td("MRP", "2"), td("lone", ""), td("", "lone"), td("Expiry", "3"), "<tr></tr></table>"),
        t('<meta property="og:title" content="Old"><meta property="og:title" content="Shop ', n, '"><script type="application/ld+json">[{"@type":"Thing"},{"@graph":[{"@type":["product"],"name":"Item ', n,
          '","brand":{"name":"Brand ', n, '"},"offers":{"price":"7.00"}}]}]</script><script type="application/ld+json">{broken</script>'),
        t('<meta property="og:title" content="Amazon"><span id="productTitle"> Item ', n, ' </span><table id="productDetails_techSpec_section_1"><tbody>', td("Item Weight", t(n, " kg")), td("Importer", "Dock Ltd"), "</tbody></table>"),
        t('<h1 class="v1"><span>Item ', n, '</span></h1><div class="grid-formation-dynamic"><div><div>Net Quantity</div><div>', n, " ml</div><div></div></div></div>"),
        t('<h1 class="x Title">Item ', n, '</h1><div class="PackSize-a">', n, ' l</div><span class="CountryOfOrigin-b">Nepal</span>'),
    ]
    host = F.get(F.array(*[F.lit(h) for h in ("", "", "", "", "", "https://www.amazon.in/dp/", "https://www.flipkart.com/p/", "https://blinkit.com/prn/")]), k.cast("int"))
    url = F.when(host == "", F.col("url")).otherwise(F.concat(host, n))
    html = F.concat(F.coalesce("html", F.lit("")), F.get(F.array(*forms), k.cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", url.alias("url"), html.alias("html"))


@query("""SELECT page_id, f.field_name, replace(f.v, '#', CAST(page_id AS VARCHAR)) AS field_value, CAST(0.75 AS DOUBLE) AS confidence, 'CSS_SELECTOR' AS strategy FROM pages JOIN (VALUES
    (0, 'net_quantity', '# g'), (0, 'packer_name', 'Packer #'), (1, 'country_of_origin', 'Nepal'), (1, 'best_before_date', '# days'), (2, 'manufacturer_name', 'Maker #'),
    (5, 'net_quantity', '# kg'), (5, 'importer_name', 'Dock Ltd'), (6, 'net_quantity', '# ml')) f(k, field_name, v) ON page_id % 8 = f.k""")
def page_label_candidates(spark, sf_dir):
    """Tables, grids and bullets of every page, wherever they stand; a row counts once whatever wraps it, and tables
    that aren't mostly pairs give none."""
    parts = H.html_parts(_blocks(spark, sf_dir))
    return H.label_candidates(H.table_pairs(parts).unionByName(H.bullet_pairs(parts))).drop("ord")


#: What each form of a page shows to the structured strategies: form, strategy, field, value, confidence.
_SHOWN = """(VALUES (4, 'JSON_LD', 'product_name', 'Item #', 0.95), (4, 'JSON_LD', 'manufacturer_name', 'Brand #', 0.3), (4, 'OPEN_GRAPH', 'product_name', 'Shop #', 0.6),
    (5, 'OPEN_GRAPH', 'product_name', 'Amazon', 0.6), (5, 'CSS_SELECTOR', 'product_name', 'Item #', 0.7), (5, 'CSS_SELECTOR', 'net_quantity', '# kg', 0.75), (5, 'CSS_SELECTOR', 'importer_name', 'Dock Ltd', 0.75),
    (6, 'CSS_SELECTOR', 'product_name', 'Item #', 0.6), (6, 'CSS_SELECTOR', 'net_quantity', '# ml', 0.75),
    (7, 'CSS_SELECTOR', 'product_name', 'Item #', 0.65), (7, 'CSS_SELECTOR', 'net_quantity', '# l', 0.65), (7, 'CSS_SELECTOR', 'country_of_origin', 'Nepal', 0.65)) f(k, strategy, field_name, v, c)"""


@query(f"""SELECT page_id, f.strategy, f.field_name, replace(f.v, '#', CAST(page_id AS VARCHAR)) AS field_value, CAST(f.c AS DOUBLE) AS confidence FROM pages JOIN {_SHOWN} ON page_id % 8 = f.k""")
def page_field_candidates(spark, sf_dir):
    """What the structured strategies find on every page (document_emails has free text)."""
    found = H.page_candidates(H.html_parts(_blocks(spark, sf_dir)).persist(StorageLevel.DISK_ONLY))
    return found.filter("strategy <> 'FALLBACK_TEXT'").select("page_id", "strategy", "field_name", "field_value", "confidence")


@query("""SELECT page_id, CASE page_id % 8 WHEN 4 THEN 'Shop ' || page_id WHEN 5 THEN 'Item ' || page_id WHEN 6 THEN 'Item ' || page_id END AS title FROM pages WHERE page_id % 8 IN (4, 5, 6)""")
def page_shop_titles(spark, sf_dir):
    """Og over JSON-LD; the platform's own title over an og title that is the shop's name."""
    parts = H.html_parts(_blocks(spark, sf_dir).filter("page_id % 8 IN (4, 5, 6)")).persist(StorageLevel.DISK_ONLY)
    return H.product_record(parts, H.json_ld_products(parts)).select("page_id", "title")


@query(f"""WITH n AS (SELECT page_id, count(DISTINCT f.field_name) AS n FROM pages LEFT JOIN {_SHOWN} ON page_id % 8 = f.k GROUP BY 1)
    SELECT page_id, page_id % 5 <> 0 AND n <= 1 AS hollow, page_id % 5 <> 0 AND n > 1 AS usable_page FROM n""")
def hollow_pages(spark, sf_dir):
    """Pages whose structured candidates cover at most one field; pages without candidates count too."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 5 == 0, "TIMEOUT").otherwise("SUCCESS").alias("fetch_status"))
    return context.page_facts(pages.withColumn("inspection_id", F.col("page_id")), page_field_candidates(spark, sf_dir)).select(F.col("inspection_id").alias("page_id"), "hollow", "usable_page")


@query(f"""WITH {LST}, p AS (SELECT *, has_page AND fetch_status = 'SUCCESS' AS ok FROM lst)
    SELECT inspection_id, 'product_name' AS field_name, title AS field_value, CASE platform WHEN 'amazon' THEN 0.7 WHEN 'flipkart' THEN 0.6 WHEN 'blinkit' THEN 0.65 ELSE 0.95 END::DOUBLE AS confidence FROM p WHERE ok
    UNION ALL SELECT inspection_id, 'country_of_origin', country_text, CASE platform WHEN 'blinkit' THEN 0.65 ELSE 0.75 END::DOUBLE FROM p WHERE ok AND platform <> 'generic' AND country_text IS NOT NULL
    UNION ALL SELECT inspection_id, 'net_quantity', qty_text, CASE platform WHEN 'blinkit' THEN 0.65 ELSE 0.75 END::DOUBLE FROM p WHERE ok AND platform <> 'generic' AND qty_text IS NOT NULL""")
def captured_fields(spark, sf_dir):
    """Structured candidates of the listings' pages, the best for each field."""
    found = captures.candidates(captures.listing_pages(listings(spark, sf_dir)), "inspection_id")
    some = found.filter("strategy <> 'FALLBACK_TEXT' AND field_name IN ('product_name', 'country_of_origin', 'net_quantity')")
    best = declare.best_declaration(some.withColumns({"source_type": F.lit("STRUCTURED_METADATA"), "normalized_value": F.lit(None).cast("string")}))
    return best.select("inspection_id", "field_name", "field_value", "confidence")


@query()
def captured_checks(spark, sf_dir):
    """C1 to R19 in one job: from the HTML of the listings' pages to the outcome of every rule."""
    return captures.checks(listings(spark, sf_dir)).select("inspection_id", "rule_key", "status")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'country_of_origin' WHEN 1 THEN 'mrp' WHEN 2 THEN 'manufacturer_name' END AS field_name FROM part WHERE p_partkey % 4 <> 3""")
def label_fields(spark, sf_dir):
    """Labels are matched whole."""
    k = F.col("p_partkey")
    label = F.when(k % 4 == 0, " Country of Origin ").when(k % 4 == 1, "M.R.P").when(k % 4 == 2, "Manufacturer").otherwise("Is Discontinued By Manufacturer")
    pairs = table(spark, sf_dir, "part").select("p_partkey", F.lit(0).alias("ord"), label.alias("label"), F.lit("v").alias("value"))
    return H.label_candidates(pairs, "p_partkey").select("p_partkey", "field_name")


@query()
def fuzzy_names(spark, sf_dir):
    """similarity of each part's name with its words turned round, and with the next one's."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("a"))
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b"))
    turned = F.array_join(F.reverse(F.split("a", " ")), " ")
    return p.join(q, "p_partkey").select("p_partkey", token_sort_ratio(F.col("a"), turned).alias("turned"), token_sort_ratio(F.col("a"), F.col("b")).alias("next"))


@query(f"""WITH {LST} SELECT inspection_id, field_name, v AS field_value, floor(c * greatest(ocr_conf, 0.3)::DOUBLE * 1000 + 0.5) / 1000 AS confidence FROM
    (SELECT inspection_id, ocr_conf, 'mrp' AS field_name, ocr_mrp AS v, 0.85::DOUBLE AS c FROM lst WHERE n_images > 0 UNION ALL SELECT inspection_id, ocr_conf, 'net_quantity', ocr_qty, 0.85::DOUBLE FROM lst WHERE n_images > 0
     UNION ALL SELECT inspection_id, ocr_conf, 'country_of_origin', ocr_country, 0.8::DOUBLE FROM lst WHERE n_images > 0) WHERE v IS NOT NULL""")
def ocr_fields(spark, sf_dir):
    """C17-C20: the words on every listing's label, in reading order, as declarations with their boxes' confidence."""
    lst = listings(spark, sf_dir)
    return captures.image_declarations(captures.listing_images(lst), captures.listing_boxes(lst)).select("inspection_id", "field_name", "field_value", "confidence")


@query(f"""WITH {LST} SELECT inspection_id, n_images, round(ocr_conf, 6)::DOUBLE AS ocr_conf FROM lst WHERE n_images > 0""")
def image_evidence(spark, sf_dir):
    """Images and mean OCR confidence of every inspection, over the words of all its images."""
    lst = listings(spark, sf_dir)
    facts = context.image_facts(captures.listing_images(lst), captures.listing_boxes(lst))
    return facts.select("inspection_id", "n_images", F.round("ocr_conf", 6).alias("ocr_conf"))


@query()
def ocr_audit(spark, sf_dir):
    """Words of each listing laid out on an image, read in order, and turned into declarations."""
    from packlens.operators import ocr
    from packlens.plans.synth import listing_text

    lst = listings(spark, sf_dir).filter("n_images > 0").repartition("k").withColumn("text", listing_text())
    words = lst.select(F.concat(F.lit("m"), F.col("k").cast("string")).alias("image_id"), F.col("ocr_conf").cast("double").alias("confidence"), F.posexplode(F.split("text", " ")).alias("ord", "text"))
    box = F.struct((F.col("ord") % 4 * 50).cast("int").alias("x"), (F.floor(F.col("ord") / 4) * 20 + F.col("ord") % 3).cast("int").alias("y"), F.lit(40).alias("width"), F.lit(12).alias("height"))
    return ocr.ocr_declarations(ocr.image_words(ocr.reading_order(words.withColumn("bbox", box))))
