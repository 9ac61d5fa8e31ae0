"""Queries of the audit itself: declarations, contexts, rule checks, queues and dashboards."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packlens.functions import vocab
from packlens.functions.vocab import LISTING_SOURCES
from packlens.operators import classify, declare, report, rules, versioning
from packlens.plans import audit, captures
from packlens.plans.oracle import CHECKS, CTX, LST, OVERALL, PNC
from packlens.plans.synth import listings
from packlens.session import scratch, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.checks(listings(spark, sf_dir))


def _overall(spark: SparkSession, sf_dir: str, checks: DataFrame | None = None) -> DataFrame:
    lst = listings(spark, sf_dir)
    return lst.join(rules.overall_status(checks if checks is not None else audit.checks(lst)), "inspection_id")


@query(f"WITH {OVERALL} SELECT overall_status, count(*) AS n FROM overall GROUP BY 1")
def overall_status_counts(spark, sf_dir):
    return rules.overall_status(_checks(spark, sf_dir)).groupBy("overall_status").agg(F.count("*").alias("n"))


_PAGE = (
    ("product_name", "title", "title", 0.6), ("mrp", "replace(mrp_text, 'Rs. ', '')", "replace(mrp_text, 'Rs. ', '')", 0.85), ("net_quantity", "qty_text", None, 0.85),
    ("country_of_origin", "country_text", "country_text", 0.8), ("manufacturer_name", "maker_text", "maker_text", 0.75), ("manufacturer_address", "maker_addr", "maker_addr", 0.55),
    ("importer_name", "importer_text", "importer_text", 0.75), ("importer_address", "importer_addr", "importer_addr", 0.55), ("consumer_care_name", "care_name", "care_name", 0.6),
    ("consumer_care_phone", "care_phone", "care_phone", 0.75), ("consumer_care_email", "care_email", "care_email", 0.9), ("unit_sale_price", "unit_text", "unit_text", 0.75),
    ("mfg_date", "mfg_text", "CASE WHEN mfg_text IS NOT NULL THEN '2024-05-01' END", 0.7), ("best_before_date", "best_text", "CASE WHEN best_text IS NOT NULL THEN '2025-12-01' END", 0.7),
)
_QTY = "CAST(CAST(split_part(qty_text, ' ', 1) AS BIGINT) * CASE WHEN qty_text LIKE '%kg' THEN 1000 ELSE 1 END AS VARCHAR) || CASE WHEN qty_text LIKE '%ml' THEN 'ml' ELSE 'g' END"


_PAGE_SQL = (
    f"WITH {LST}, ok AS (SELECT * FROM lst WHERE has_page AND fetch_status = 'SUCCESS'), u AS ("
    + " UNION ALL ".join(f"SELECT inspection_id, '{f}' AS field_name, {v} AS field_value, {n or _QTY} AS normalized_value, CAST({c} AS DOUBLE) AS confidence FROM ok" for f, v, n, c in _PAGE)
    + ") SELECT * FROM u WHERE field_value IS NOT NULL"
)


@query(_PAGE_SQL)
def page_declarations(spark, sf_dir):
    """Candidates of all patterns, normalised and de-duplicated."""
    d = audit.page_declarations(listings(spark, sf_dir))
    return d.select("inspection_id", "field_name", "field_value", "normalized_value", "confidence")


@query(f"SELECT inspection_id, field_name, field_value, row_number() OVER (PARTITION BY inspection_id ORDER BY field_name, confidence DESC, field_value) AS place FROM ({_PAGE_SQL})")
def declarations_by_field(spark, sf_dir):
    """An inspection's declarations in the order of their fields."""
    d = report.declarations_by_field(audit.page_declarations(listings(spark, sf_dir)))
    return d.select("inspection_id", "field_name", "field_value", "place")


@query(
    f"WITH {CTX} SELECT inspection_id, 'mrp' AS field_name, mrp AS field_value, mrp_c AS confidence FROM ctx WHERE mrp IS NOT NULL UNION ALL "
    "SELECT inspection_id, 'net_quantity', qty, qty_c FROM ctx WHERE qty IS NOT NULL UNION ALL SELECT inspection_id, 'country_of_origin', country, country_c FROM ctx WHERE country IS NOT NULL"
)
def best_declarations(spark, sf_dir):
    """The best of page and image declarations."""
    best = declare.best_declaration(audit.declarations(listings(spark, sf_dir)))
    return best.filter(F.col("field_name").isin("mrp", "net_quantity", "country_of_origin")).select("inspection_id", "field_name", "field_value", "confidence")


@query(f"WITH {CTX} SELECT inspection_id, usable AS usable_page, n_images, suff AS sufficient, floor(q * 10000 + 0.5) / 10000 AS quality, origin, category, nf + CASE WHEN on_mrp IS NULL AND ocr_mrp IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN on_qty IS NULL AND ocr_qty IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN on_country IS NULL AND ocr_country IS NOT NULL THEN 1 ELSE 0 END AS n_fields FROM ctx")
def inspection_contexts(spark, sf_dir):
    """Evidence, origin and category of every inspection."""
    c = audit.contexts(listings(spark, sf_dir))
    return c.select("inspection_id", "usable_page", "n_images", "sufficient", (F.floor(F.col("quality") * 10000 + 0.5) / 10000).alias("quality"), "origin", "category", F.size("best").alias("n_fields"))


@query(f"WITH {CHECKS} SELECT inspection_id, rule_key, severity, status, confidence FROM checks")
def rule_checks(spark, sf_dir):
    """Every rule against every inspection."""
    return _checks(spark, sf_dir).select("inspection_id", "rule_key", "severity", "status", "confidence")


@query(f"""WITH {CHECKS} SELECT inspection_id, rule_key, CASE rule_key WHEN 'R6-1E-MRP' THEN 'MAJOR' ELSE severity END AS severity, status, confidence FROM checks WHERE rule_key <> 'R9-MANNER'""")
def stored_rule_checks(spark, sf_dir):
    """The same by the current versions of a rule store, in which one rule has a second version and one is inactive."""
    old = rules.rule_frame(spark).withColumns({"version_number": F.lit(1), "active": F.col("rule_key") != "R9-MANNER", "is_current": F.col("rule_key") != "R6-1E-MRP"})
    new = old.filter("rule_key = 'R6-1E-MRP'").withColumns({"version_number": F.lit(2), "severity": F.lit("MAJOR"), "is_current": F.lit(True)})
    current = versioning.current_rules(old.unionByName(new))
    return rules.evaluate(audit.contexts(listings(spark, sf_dir)), current).select("inspection_id", "rule_key", "severity", "status", "confidence")


@query(f"""WITH {CTX} SELECT inspection_id, concat_ws(',', CASE WHEN cname IS NULL THEN 'consumer_care_name' END, 'consumer_care_address', CASE WHEN cphone IS NULL THEN 'consumer_care_phone' END,
    CASE WHEN cmail IS NULL THEN 'consumer_care_email' END) AS missing_care, CASE WHEN has_page THEN concat_ws(',', CASE WHEN name IS NULL THEN 'product_name' END, CASE WHEN on_qty IS NULL THEN 'net_quantity' END,
    CASE WHEN on_mrp IS NULL THEN 'mrp' END, CASE WHEN maker IS NULL AND importer IS NULL THEN 'manufacturer_name|packer_name|importer_name' END,
    CASE WHEN cname IS NULL AND cphone IS NULL AND cmail IS NULL THEN 'consumer_care_name|consumer_care_address|consumer_care_phone|consumer_care_email' END) END AS missing_groups FROM ctx""")
def missing_declarations(spark, sf_dir):
    """U4: what consumer care and display lack."""
    m = rules.missing_members(audit.contexts(listings(spark, sf_dir)))
    return m.select("inspection_id", *[F.array_join(c, ",").alias(c) for c in ("missing_care", "missing_groups")])


@query(f"""WITH {LST}, o AS (SELECT 'o' || s_suppkey AS officer_id, s_name AS officer_name FROM supplier WHERE s_suppkey < 4),
    p AS (SELECT product_id, arg_max(title, k) AS product_title FROM lst WHERE k % 3 > 0 GROUP BY 1)
    SELECT inspection_id, platform, run_status, officer_id, officer_name, product_title FROM lst LEFT JOIN o USING (officer_id) LEFT JOIN p USING (product_id)""")
def inspection_summaries(spark, sf_dir):
    """Inspections with the officer's name and the product's title; some officers and products are unknown."""
    lst = listings(spark, sf_dir)
    officers = table(spark, sf_dir, "supplier").filter("s_suppkey < 4").select(F.concat(F.lit("o"), F.col("s_suppkey").cast("string")).alias("officer_id"), F.col("s_name").alias("full_name"))
    products = lst.filter("k % 3 > 0").groupBy("product_id").agg(F.max_by("title", "k").alias("title"))
    return report.summary_rows(lst, officers, products).select("inspection_id", "platform", "run_status", "officer_id", "officer_name", "product_title")


@query(f"WITH {CHECKS} SELECT rule_key, status, count(*) AS n FROM checks GROUP BY ALL")
def checks_by_rule(spark, sf_dir):
    return _checks(spark, sf_dir).groupBy("rule_key", "status").agg(F.count("*").alias("n"))


@query(f"WITH {CHECKS} SELECT inspection_id, rule_key, severity, confidence FROM checks WHERE status = {PNC}")
def violation_rows(spark, sf_dir):
    return rules.violations(_checks(spark, sf_dir)).select("inspection_id", "rule_key", "severity", "confidence")


@query(f"""WITH {CTX}, u AS (SELECT inspection_id, 'mrp' AS field_name, mrp AS v, on_mrp IS NOT NULL AND NOT coalesce(ocr_mrp IS NOT NULL AND oc > 0.85, FALSE) AS web FROM ctx
    UNION ALL SELECT inspection_id, 'net_quantity', qty, on_qty IS NOT NULL AND NOT coalesce(ocr_qty IS NOT NULL AND oc > 0.85, FALSE) FROM ctx
    UNION ALL SELECT inspection_id, 'mfg_date', mfg, TRUE FROM ctx)
    SELECT r.rule_key, field_name, CASE WHEN web THEN 'LISTING' ELSE 'IMAGE' END AS evidence_type, count(*) AS n FROM u JOIN (VALUES ('mrp', 'R6-1E-MRP'), ('mrp', 'CONSISTENCY-MRP'),
    ('net_quantity', 'R6-1C-NET-QUANTITY'), ('net_quantity', 'R11-QTY-BASIS'), ('net_quantity', 'CONSISTENCY-NET-QUANTITY'), ('mfg_date', 'R6-1D-MFG-DATE')) r(f, rule_key) ON r.f = field_name
    WHERE v IS NOT NULL GROUP BY ALL""")
def evidence_rows(spark, sf_dir):
    """The declarations behind the checks, counted by rule, field and kind."""
    lst = listings(spark, sf_dir)
    d = audit.declarations(lst).persist(StorageLevel.DISK_ONLY)  # read by the checks and behind them
    ev = rules.evidence(rules.evaluate(audit.contexts(lst, d)), declare.best_declaration(d))
    return ev.filter(F.col("field_name").isin("mrp", "net_quantity", "mfg_date")).groupBy("rule_key", "field_name", "evidence_type").agg(F.count("*").alias("n"))


@query(f"""WITH {CHECKS} SELECT inspection_id, count(*) FILTER (status = 'PASS') AS n_pass, count(*) FILTER (status = {PNC}) AS n_potential_non_compliance,
    count(*) FILTER (status = 'NEEDS_MANUAL_REVIEW') AS n_needs_manual_review, count(*) FILTER (status = 'UNABLE_TO_VERIFY') AS n_unable_to_verify,
    count(*) FILTER (status = 'NOT_APPLICABLE') AS n_not_applicable, count(*) AS n_total FROM checks GROUP BY 1""")
def status_counts(spark, sf_dir):
    return report.status_counts(_checks(spark, sf_dir))


@query(f"WITH {CHECKS} SELECT inspection_id, status, string_agg(rule_key, ',' ORDER BY rule_key) AS rule_keys FROM checks GROUP BY ALL")
def status_groups(spark, sf_dir):
    g = report.status_groups(_checks(spark, sf_dir))
    return g.withColumn("rule_keys", F.array_join("rule_keys", ","))


@query(f"""WITH {OVERALL}, m AS (SELECT inspection_id, count(*) AS nv, count(*) FILTER (severity = 'CRITICAL') AS nc, max(confidence) AS mc FROM checks WHERE status = {PNC} GROUP BY 1)
    SELECT batch_id, inspection_id, coalesce(nv, 0) AS n_violations, coalesce(nc, 0) AS n_critical, row_number() OVER (PARTITION BY batch_id ORDER BY
      CASE overall_status WHEN {PNC} THEN 0 WHEN 'NEEDS_MANUAL_REVIEW' THEN 1 WHEN 'UNABLE_TO_VERIFY' THEN 2 ELSE 3 END, coalesce(nc, 0) DESC, coalesce(nv, 0) DESC, coalesce(mc, 0) DESC, inspection_id) AS place
    FROM overall LEFT JOIN m USING (inspection_id)""")
def triage_queue(spark, sf_dir):
    """Each batch worst first."""
    lst = listings(spark, sf_dir)
    items = lst.select("inspection_id", "batch_id").join(report.outcomes(audit.checks(lst)), "inspection_id")
    return report.triage_queue(items).select("batch_id", "inspection_id", "n_violations", "n_critical", "place")


@query(f"WITH {CHECKS} SELECT inspection_id, rule_key, confidence, row_number() OVER (PARTITION BY inspection_id ORDER BY confidence DESC, rule_key) AS priority FROM checks WHERE status = {PNC}")
def priority_findings(spark, sf_dir):
    return report.priority_findings(_checks(spark, sf_dir)).select("inspection_id", "rule_key", "confidence", "priority")


@query(f"""WITH {CHECKS}, l AS (SELECT *, CASE status WHEN {PNC} THEN 0 WHEN 'UNABLE_TO_VERIFY' THEN 1 WHEN 'NEEDS_MANUAL_REVIEW' THEN 2 END AS r FROM checks)
    SELECT inspection_id, rule_key, CASE r WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Review' END AS level, row_number() OVER (PARTITION BY inspection_id ORDER BY r, rule_key) AS place FROM l WHERE r IS NOT NULL""")
def officer_checklist(spark, sf_dir):
    return report.officer_checklist(_checks(spark, sf_dir)).select("inspection_id", "rule_key", "level", "place")


@query(f"WITH {CHECKS} SELECT rule_key, count(*) AS n FROM checks WHERE status IN ({PNC}, 'NEEDS_MANUAL_REVIEW', 'UNABLE_TO_VERIFY') GROUP BY 1")
def key_findings(spark, sf_dir):
    """P11."""
    return report.key_findings(_checks(spark, sf_dir)).groupBy("rule_key").agg(F.count("*").alias("n"))


@query(f"""WITH {CHECKS}, e AS (SELECT c.inspection_id, c.rule_key, c.status, on_mrp IS NOT NULL AS page, (on_mrp IS NOT NULL)::INT + (ocr_mrp IS NOT NULL)::INT AS n FROM checks c JOIN ctx USING (inspection_id) WHERE rule_key = 'CONSISTENCY-MRP')
    SELECT inspection_id, 'MRP' AS field_label, CASE WHEN n = 2 THEN 'Listing + Image' WHEN n = 1 AND page THEN 'Listing only' WHEN n = 1 THEN 'Image only' ELSE 'Incomplete' END AS compared,
    CASE status WHEN 'PASS' THEN 'Consistent' WHEN {PNC} THEN 'Mismatch' ELSE 'Inconclusive' END AS result,
    CASE status WHEN {PNC} THEN 'Verify MRP consistency: listing vs. product image directly on the package/listing before treating this as a violation.' WHEN 'UNABLE_TO_VERIFY' THEN
      'Insufficient evidence was captured — re-inspect with clearer photos or listing data.' WHEN 'NEEDS_MANUAL_REVIEW' THEN 'Requires manual or visual verification by the officer.' ELSE 'No action required.' END AS action FROM e""")
def consistency_section(spark, sf_dir):
    """W5, J6, R18 for the price."""
    lst = listings(spark, sf_dir)
    d = audit.declarations(lst).filter("field_name = 'mrp'")
    sides = d.groupBy("inspection_id").agg(F.count_distinct("source_type").alias("n"), F.bool_or(F.col("source_type").isin(*LISTING_SOURCES)).alias("page"))
    c = audit.checks(lst).filter("rule_key = 'CONSISTENCY-MRP'").join(sides, "inspection_id", "left")
    return report.consistency_section(c, F.coalesce("n", F.lit(0)), F.coalesce("page", F.lit(False))).select("inspection_id", "field_label", "compared", "result", "action")


@query(f"""WITH {OVERALL}, o AS (SELECT batch_id, overall_status, count(*) AS n, count(*) FILTER (run_status IN ('COMPLETED', 'FAILED')) AS d FROM overall JOIN (SELECT inspection_id, run_status FROM lst) USING (inspection_id) GROUP BY ALL)
    SELECT batch_id, CAST(sum(n) AS BIGINT) AS total, CAST(sum(d) AS BIGINT) AS processed, string_agg(overall_status || '=' || n, ',' ORDER BY overall_status) AS outcomes FROM o GROUP BY 1""")
def batch_summary(spark, sf_dir):
    """A13."""
    b = report.batch_summary(_overall(spark, sf_dir))
    text = F.array_join(F.array_sort(F.transform(F.map_entries("outcomes"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",")
    return b.select("batch_id", "total", "processed", text.alias("outcomes"))


@query(f"""WITH {OVERALL} SELECT count(*) AS total, count(*) FILTER (overall_status = 'PASS') AS n_pass, count(*) FILTER (overall_status = {PNC}) AS n_potential_non_compliance,
    count(*) FILTER (overall_status = 'NEEDS_MANUAL_REVIEW') AS n_needs_manual_review, count(*) FILTER (overall_status = 'UNABLE_TO_VERIFY') AS n_unable_to_verify,
    count(*) FILTER (overall_status = 'NOT_APPLICABLE') AS n_not_applicable FROM overall""")
def dashboard_headline(spark, sf_dir):
    """A14."""
    return report.headline(_overall(spark, sf_dir))


@query(f"WITH {LST} SELECT platform, count(*) AS n FROM lst GROUP BY 1")
def inspections_by_platform(spark, sf_dir):
    """The platform is read off the URL's host."""
    from packlens.operators.intake import platform

    lst = listings(spark, sf_dir).withColumn("platform", platform(F.col("url")))
    return report.by_platform(lst)


@query(f"""WITH {LST}, l AS (SELECT product_id, max(k) AS k FROM lst GROUP BY 1), p AS (SELECT product_id, CASE WHEN k % 50 = 0 THEN 'HOUSEHOLD' ELSE CASE k % 6 WHEN 0 THEN 'FOOD' WHEN 1 THEN 'COSMETIC_PERSONAL_CARE' WHEN 2 THEN 'HOUSEHOLD' WHEN 3 THEN 'FOOD' ELSE 'UNKNOWN' END END AS category,
    CASE k % 6 WHEN 0 THEN 0.75 WHEN 1 THEN 0.65 WHEN 2 THEN 0.75 WHEN 3 THEN 0.65 ELSE 0.1 END AS c FROM l) SELECT category, count(*) AS n, round(sum(CAST(c AS DOUBLE)), 2) AS confidence FROM p GROUP BY 1""")
def products_by_category(spark, sf_dir):
    """Products by the category of their latest listing: keyword votes, with a manual category on some."""
    latest = listings(spark, sf_dir).groupBy("product_id").agg(F.max_by(F.struct("k", "title", "brand"), "k").alias("l")).select("product_id", "l.*")
    one = latest.withColumn("c", classify.classify(F.concat_ws(" ", "title", "brand")))
    cat = classify.final_category(F.col("k") % 50 == 0, F.lit("HOUSEHOLD"), F.col("c.category"))
    return one.groupBy(cat.alias("category")).agg(F.count("*").alias("n"), F.round(F.sum("c.confidence"), 2).alias("confidence"))


@query(f"WITH {CHECKS} SELECT rule_key, count(*) AS n FROM checks WHERE status = {PNC} GROUP BY 1 ORDER BY n DESC, rule_key LIMIT 10")
def top_violated_rules(spark, sf_dir):
    """A17, J4."""
    return report.top_violations(rules.violations(_checks(spark, sf_dir)), "rule_key", 10)


@query(f"WITH {CHECKS} SELECT severity, count(*) AS n FROM checks WHERE status = {PNC} GROUP BY 1 ORDER BY n DESC, severity LIMIT 5")
def top_violation_severities(spark, sf_dir):
    return report.top_violations(rules.violations(_checks(spark, sf_dir)), "severity", 5)


_TITLES = ", ".join("('{}', '{}')".format(r.rule_key, r.title.replace("'", "''")) for r in rules.SEEDED)


@query(f"WITH {CHECKS} SELECT summary, count(*) AS n FROM checks JOIN (VALUES {_TITLES}) t(rule_key, summary) USING (rule_key) WHERE status = {PNC} GROUP BY 1 ORDER BY n DESC, summary LIMIT 5")
def top_issue_titles(spark, sf_dir):
    """A18."""
    return report.top_violations(rules.violations(_checks(spark, sf_dir)), "summary", 5)


@query(f"""WITH {CHECKS} SELECT inspection_id, '{{"rules":[' || string_agg('{{"rule_key":"' || rule_key || '","status":"' || status || '"}}', ',' ORDER BY rule_key) || ']}}' AS snapshot FROM checks GROUP BY 1""")
def report_snapshots(spark, sf_dir):
    """S8."""
    return report.report_snapshot(_checks(spark, sf_dir))


@query(f"WITH {CHECKS} SELECT inspection_id, 'Packaged Commodities Rules' AS source_document, 1 AS source_no FROM checks GROUP BY 1")
def source_documents(spark, sf_dir):
    """W4."""
    return report.source_index(_checks(spark, sf_dir))


#: A child kind as one text: its rows in order, columns parted by '=', rows by ','.
_NESTED = f"""WITH {CHECKS}, decl AS (SELECT inspection_id, field_name || '=' || field_value AS t, field_name AS a, field_value AS b FROM ({_PAGE_SQL})),
    d AS (SELECT inspection_id, string_agg(t, ',' ORDER BY a, b) AS declarations FROM decl GROUP BY 1),
    c AS (SELECT inspection_id, string_agg(rule_key || '=' || status || CASE WHEN status = {PNC} AND k % 4 = 0 THEN '=reviewed' ELSE '' END, ',' ORDER BY rule_key) AS checks FROM checks GROUP BY 1),
    i AS (SELECT inspection_id, string_agg('m' || n || '=' || CASE WHEN n = 1 THEN 'MRP+price' ELSE '' END, ',' ORDER BY n) AS images FROM (SELECT inspection_id, unnest(range(1, n_images + 1)) AS n FROM lst) GROUP BY 1)
    SELECT inspection_id, url, coalesce(declarations, '') AS declarations, checks, coalesce(images, '') AS images, CASE WHEN has_page THEN fetch_status ELSE '' END AS pages,
      CASE run_status WHEN 'CREATED' THEN '' WHEN 'IN_PROGRESS' THEN '1=SCRAPE' ELSE '1=SCRAPE,2=DONE' END AS events FROM lst JOIN c USING (inspection_id) LEFT JOIN d USING (inspection_id) LEFT JOIN i USING (inspection_id)"""


@query(_NESTED)
def nested_inspections(spark, sf_dir):
    """Inspections with declarations, checks and their reviews, images and their words, pages, and events as ordered arrays."""
    lst = listings(spark, sf_dir)
    images = lst.filter("n_images > 0").select("inspection_id", F.explode(F.sequence(F.lit(1), F.col("n_images").cast("int"))).alias("n"))
    images = images.withColumn("image_id", F.concat_ws("/", "inspection_id", F.col("n").cast("string")))
    words = F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(t).alias("text")) for o, t in ((2, "price"), (1, "MRP"))])
    nested_images = report.nested_documents(images, "image_id", words=images.filter("n = 1").select("image_id", F.inline(words))).select("inspection_id", "n", "words")
    checks = audit.checks(lst).select("inspection_id", "rule_key", "status").withColumn("check_id", F.concat_ws("/", "inspection_id", "rule_key"))
    seen = (F.col("status") == vocab.PNC) & (F.substring("inspection_id", 2, 20).cast("bigint") % 4 == 0)
    nested_checks = report.nested_documents(checks, "check_id", reviews=checks.filter(seen).select("check_id", F.lit("reviewed").alias("note"))).select("inspection_id", "rule_key", "status", "reviews")
    stage = lambda n, name: F.struct(F.lit(n).alias("n"), F.lit(name).alias("stage"))
    stages = F.when(F.col("run_status") == "IN_PROGRESS", F.array(stage(1, "SCRAPE"))).when(F.col("run_status") != "CREATED", F.array(stage(2, "DONE"), stage(1, "SCRAPE")))
    full = report.nested_documents(
        lst.select("inspection_id", "url"), declarations=audit.page_declarations(lst).select("inspection_id", "field_name", "field_value"), checks=nested_checks, images=nested_images,
        pages=lst.filter("has_page").select("inspection_id", "fetch_status"), events=lst.select("inspection_id", F.inline(stages)),
    )
    text = lambda kind, one: F.array_join(F.transform(kind, one), ",").alias(kind)
    joined = lambda *xs: F.concat_ws("=", *xs)
    return full.select(
        "inspection_id", "url", text("declarations", lambda x: joined(x["field_name"], x["field_value"])),
        text("checks", lambda x: joined(x["rule_key"], x["status"], F.transform(x["reviews"], lambda r: r["note"]))),
        text("images", lambda x: F.concat(F.lit("m"), x["n"].cast("string"), F.lit("="), F.array_join(F.transform(x["words"], lambda w: w["text"]), "+"))),
        text("pages", lambda x: x["fetch_status"]), text("events", lambda x: joined(x["n"].cast("string"), x["stage"])),
    )


@query(f"WITH {LST} SELECT inspection_id, platform, 'o2' AS officer_id FROM lst WHERE officer_id = 'o2' ORDER BY created_day DESC, inspection_id LIMIT 20 OFFSET 10")
def inspection_search(spark, sf_dir):
    """One officer's inspections, newest first, the second page."""
    at = F.timestamp_add("DAY", F.col("created_day").cast("int"), F.lit("2024-01-01").cast("timestamp"))
    return report.search(listings(spark, sf_dir).withColumn("created_at", at), 20, 10, officer_id="o2").select("inspection_id", "platform", "officer_id")


@query(f"WITH {LST} SELECT strftime(DATE '2024-01-01' + CAST(created_day AS INT), '%Y-%m-%d') AS day, count(*) AS n FROM lst WHERE created_day >= 29 GROUP BY 1")
def inspection_trend(spark, sf_dir):
    """Thirty days before a given day."""
    at = F.timestamp_add("DAY", F.col("created_day").cast("int"), F.lit("2024-01-01").cast("timestamp"))
    return report.trend(listings(spark, sf_dir).withColumn("created_at", at), "2024-02-29", 30)


@query(f"""WITH {LST} SELECT CASE WHEN run_status = 'IN_PROGRESS' THEN 'FAILED' ELSE run_status END AS run_status, count(*) AS n, count(*) FILTER (run_status = 'IN_PROGRESS') AS n_events FROM lst GROUP BY 1""")
def stale_run_sweep(spark, sf_dir):
    """A23."""
    lst = listings(spark, sf_dir)
    batches = lst.select("batch_id").distinct().withColumn("status", F.lit("IN_PROGRESS"))
    fixed, _, events = report.sweep_stale(lst, batches, "2024-03-01")
    n = events.groupBy("inspection_id").agg(F.count("*").alias("e"))
    return fixed.join(n, "inspection_id", "left").groupBy("run_status").agg(F.count("*").alias("n"), F.coalesce(F.sum("e"), F.lit(0)).alias("n_events"))


@query(f"WITH {CHECKS} SELECT inspection_id, rule_key, severity, status, confidence FROM checks")
def incremental_checks(spark, sf_dir):
    """Captures arrive in three waves (an old one of every listing; the newest of one half; the newest of the other half
    with late old ones of the first), and the stored checks end as those of the newest captures (by their texts, as the oracle's; test_scan runs HTML)."""
    folder = scratch(spark, "scan")
    new = listings(spark, sf_dir).withColumn("fetched_at", F.timestamp_seconds(F.lit(2_000_000) + F.col("k")))
    old = new.withColumns({"qty_text": F.lit("7 kg"), "importer_text": F.lit("Other Ltd"), "mrp_text": F.lit("Rs. 1.00"), "fetched_at": F.timestamp_seconds(F.lit(1_000_000) + F.col("k"))})
    late = old.filter("k % 2 = 0").withColumn("fetched_at", F.timestamp_seconds(F.lit(1_500_000) + F.col("k")))
    job = captures.incremental(spark, f"{folder}/state", new.schema, audit.declarations)
    for wave in (old, new.filter("k % 2 = 0"), new.filter("k % 2 = 1").unionByName(late)):
        wave.write.mode("append").parquet(f"{folder}/in")
        job.start(f"{folder}/in", f"{folder}/checkpoint").awaitTermination()
    return job.current("checks").select("inspection_id", "rule_key", "severity", "status", "confidence")
