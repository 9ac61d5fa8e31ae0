"""Queues, report sections and dashboard figures over checks, inspections and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packlens.functions.text import display_label
from packlens.functions.vocab import NA, NMR, PASS, PNC, UTV

from .places import placed
from .rules import overall_status

STATUSES = (PASS, PNC, NMR, UTV, NA)
#: How reports call outcomes, kinds of source and compared fields, and the result that a checklist shows.
STATUS_LABELS = {PASS: "Pass", PNC: "Potential Non-Compliance", NMR: "Needs Manual Review", NA: "Not Applicable", UTV: "Unable to Verify"}
SOURCE_LABELS = {"WEBPAGE_TEXT": "WEBPAGE", "STRUCTURED_METADATA": "STRUCTURED METADATA", "IMAGE_OCR": "IMAGE/OCR", "USER_INPUT": "MANUAL", "MANUAL_REVIEW": "MANUAL REVIEW"}
FIELD_LABELS = {"mrp": "MRP", "net_quantity": "Net Quantity", "product_name": "Product Name", "manufacturer_name": "Manufacturer", "importer_name": "Importer", "country_of_origin": "Country of Origin"}
RESULT_LABELS = {PNC: "Not detected / potentially non-compliant", NMR: "Requires manual/visual review", UTV: "Insufficient evidence captured"}


def _rank(c: Column, order: tuple[str, ...], other: int) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for i, s in enumerate(order):
        out = out.when(c == s, F.lit(i))
    return out.otherwise(F.lit(other))


def key_findings(checks: DataFrame) -> DataFrame:
    return checks.filter(F.col("status").isin(PNC, NMR, UTV))


def status_counts(checks: DataFrame, key: str = "inspection_id") -> DataFrame:
    """Five zero-filled counts and the total of each inspection."""
    return checks.groupBy(key).agg(*[F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in STATUSES], F.count("*").alias("n_total"))


def status_groups(checks: DataFrame, key: str = "inspection_id") -> DataFrame:
    """Per inspection and status the rule keys, by name."""
    return checks.groupBy(key, "status").agg(F.array_sort(F.collect_list("rule_key")).alias("rule_keys"))


def triage_metrics(violations: DataFrame, key: str = "inspection_id") -> DataFrame:
    return violations.groupBy(key).agg(
        F.count("*").alias("n_violations"), F.count_if(F.col("severity") == "CRITICAL").alias("n_critical"), F.max("confidence").alias("max_confidence")
    )


def outcomes(checks: DataFrame, key: str = "inspection_id") -> DataFrame:
    """overall_status and the triage metrics of each inspection by one aggregation; no finding means 0."""
    bad = F.col("status") == PNC
    return overall_status(
        checks, key, F.count_if(bad).alias("n_violations"), F.count_if(bad & (F.col("severity") == "CRITICAL")).alias("n_critical"),
        F.coalesce(F.max(F.when(bad, F.col("confidence"))), F.lit(0.0)).alias("max_confidence"),
    )


def with_metrics(inspections: DataFrame, violations: DataFrame, key: str = "inspection_id") -> DataFrame:
    j = inspections.join(triage_metrics(violations, key), key, "left")
    zero = {"n_violations": F.lit(0).cast("bigint"), "n_critical": F.lit(0).cast("bigint"), "max_confidence": F.lit(0.0)}
    return j.withColumns({c: F.coalesce(F.col(c), z) for c, z in zero.items()})


def severity_rank(status: Column) -> Column:
    """PNC, NMR, UTV, then the rest; no status comes last."""
    return F.when(status.isNull(), 4).otherwise(_rank(status, (PNC, NMR, UTV), 3))


def triage_queue(items: DataFrame, batch: str = "batch_id", key: str = "inspection_id") -> DataFrame:
    """Place of each inspection in its batch, worst first. A batch may hold most of the rows: no task holds all of it."""
    order = [severity_rank(F.col("overall_status")), F.desc("n_critical"), F.desc("n_violations"), F.desc("max_confidence"), F.col(key)]
    return placed(items, batch, order)


def priority_findings(checks: DataFrame, key: str = "inspection_id") -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("confidence"), "rule_key")
    return checks.filter(F.col("status") == PNC).withColumn("priority", F.row_number().over(w))


def officer_checklist(checks: DataFrame, key: str = "inspection_id") -> DataFrame:
    """High (PNC), Medium (UTV), Review (NMR), in the order of the rules within."""
    level = F.when(F.col("status") == PNC, "High").when(F.col("status") == UTV, "Medium").when(F.col("status") == NMR, "Review")
    w = Window.partitionBy(key).orderBy(_rank(F.col("status"), (PNC, UTV, NMR), 3), "rule_key")
    return checks.withColumn("level", level).filter("level IS NOT NULL").withColumn("place", F.row_number().over(w))


def labelled_checks(checks: DataFrame, documents: dict[str, str] | None = None) -> DataFrame:
    """checks with status_label, result (of open outcomes; else null), action and document_label, all by fixed tables in
    generated code. documents: short names of source documents; others go by their own name, which
    source_document keeps. Null statuses have no label and no result."""
    result = F.when(F.lit(False), F.lit(""))
    for s, text in RESULT_LABELS.items():
        result = result.when(F.col("status") == s, F.lit(text))
    document = F.when(F.lit(False), F.lit(""))
    for name, short in (documents or {}).items():
        document = document.when(F.col("source_document") == name, F.lit(short))
    return checks.withColumns({
        "status_label": display_label(F.col("status"), STATUS_LABELS), "result": result, "action": officer_action(F.col("status"), F.col("title")),
        "document_label": document.otherwise(F.col("source_document")),
    })


def labelled_declarations(decl: DataFrame) -> DataFrame:
    """decl with source_label and field_label; unknown codes are shown in words."""
    return decl.withColumns({"source_label": display_label(F.col("source_type"), SOURCE_LABELS), "field_label": display_label(F.col("field_name"), FIELD_LABELS)})


def source_index(checks: DataFrame, key: str = "inspection_id", order: str = "rule_key") -> DataFrame:
    """1-based order in which an inspection's source documents first appear."""
    first = checks.groupBy(key, "source_document").agg(F.min(order).alias("first"))
    return first.select(key, "source_document", F.dense_rank().over(Window.partitionBy(key).orderBy("first")).alias("source_no"))


#: What an officer is told to do, by status; {title} is the rule's title.
ACTIONS = {
    PNC: "Verify {title} directly on the package/listing before treating this as a violation.",
    NMR: "Requires manual or visual verification by the officer.",
    UTV: "Insufficient evidence was captured — re-inspect with clearer photos or listing data.",
}
NO_ACTION = "No action required."


def officer_action(status: Column, title: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for s, text in ACTIONS.items():
        out = out.when(status == s, F.replace(F.lit(text), F.lit("{title}"), F.coalesce(title, F.lit(""))))
    return out.otherwise(F.lit(NO_ACTION))


def consistency_section(checks: DataFrame, evidence_count: Column, from_page: Column) -> DataFrame:
    """The rows of consistency checks with their labels and the officer's action. from_page: whether a single
    piece of evidence is the page's."""
    n = evidence_count
    return checks.filter("handler = 'consistency'").withColumns(
        {
            "field_label": display_label(F.get("checked_fields", F.lit(0)), FIELD_LABELS),
            "compared": F.when(n >= 2, "Listing + Image").when((n == 1) & from_page, "Listing only").when(n == 1, "Image only").otherwise("Incomplete"),
            "result": F.when(F.col("status") == PASS, "Consistent").when(F.col("status") == PNC, "Mismatch").otherwise("Inconclusive"),
            "action": officer_action(F.col("status"), F.col("title")),
        }
    )


def batch_summary(inspections: DataFrame) -> DataFrame:
    """Per batch: total, processed (completed or failed), and outcome counts as a map."""
    per = inspections.groupBy("batch_id", "overall_status").agg(F.count("*").alias("n"), F.count_if(F.col("run_status").isin("COMPLETED", "FAILED")).alias("done"))
    return per.groupBy("batch_id").agg(
        F.sum("n").alias("total"), F.sum("done").alias("processed"),
        F.map_from_entries(F.filter(F.collect_list(F.struct("overall_status", "n")), lambda e: e["overall_status"].isNotNull())).alias("outcomes"),
    )


def headline(inspections: DataFrame) -> DataFrame:
    """Totals by overall status, in one pass."""
    return inspections.agg(F.count("*").alias("total"), *[F.count_if(F.col("overall_status") == s).alias(f"n_{s.lower()}") for s in STATUSES])


def by_platform(inspections: DataFrame) -> DataFrame:
    return inspections.filter("platform IS NOT NULL").groupBy("platform").agg(F.count("*").alias("n"))


def top_violations(violations: DataFrame, by: str, k: int) -> DataFrame:
    return violations.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(k)


def review_backlog(checks: DataFrame, reviews: DataFrame) -> DataFrame:
    """Potential non-compliances that nobody has reviewed."""
    return checks.filter(F.col("status") == PNC).join(reviews.select("check_id"), "check_id", "left_anti")


def reviewed_status(checks: DataFrame, reviews: DataFrame) -> DataFrame:
    """The reviewer's status where there is one, else the automated one, which stays beside it. Reviews of
    other inspections' checks are void; of several the last counts."""
    valid = reviews.join(checks.select("check_id", "inspection_id"), ["check_id", "inspection_id"], "left_semi")
    last = valid.groupBy("check_id").agg(F.max_by("final_status", "created_at").alias("reviewed"))
    return checks.join(last, "check_id", "left").withColumn("final_status", F.coalesce("reviewed", "status")).drop("reviewed")


def trend(inspections: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Inspections per calendar day of the last days before as_of, without gap filling."""
    start = F.timestamp_add("DAY", F.lit(-days), F.lit(as_of).cast("timestamp"))
    return inspections.filter(F.col("created_at") >= start).groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n")).orderBy("day")


def declarations_by_field(decl: DataFrame, key: str = "inspection_id") -> DataFrame:
    """Place of each declaration in its inspection's list, by field; within a field the surest first, then by value."""
    w = Window.partitionBy(key).orderBy("field_name", F.desc("confidence"), "field_value")
    return decl.withColumn("place", F.row_number().over(w))


def summary_rows(inspections: DataFrame, officers: DataFrame, products: DataFrame) -> DataFrame:
    """Inspections with officer_name and product_title, null where the officer or product is unknown or none is named.
    officers: officer_id, full_name; products: product_id, title; one row each."""
    o = officers.select("officer_id", F.col("full_name").alias("officer_name"))
    p = products.select("product_id", F.col("title").alias("product_title"))
    return inspections.join(o, "officer_id", "left").join(p, "product_id", "left")


def acceptance_ratio(images: DataFrame, key: str = "inspection_id") -> DataFrame:
    return images.groupBy(key).agg(F.count("*").alias("n_images"), F.count_if("quality_acceptable").alias("n_acceptable")).withColumn("ratio", F.col("n_acceptable") / F.col("n_images"))


def run_duration(events: DataFrame, key: str = "inspection_id") -> DataFrame:
    """Duration of the last DONE event that has one."""
    done = events.filter("stage = 'DONE' AND duration_ms IS NOT NULL")
    return done.groupBy(key).agg(F.max_by("duration_ms", F.struct("created_at", "event_id")).alias("duration_ms"))


def stage_durations(events: DataFrame) -> DataFrame:
    return events.filter("duration_ms IS NOT NULL").groupBy("stage").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("max_ms"))


def sweep_stale(inspections: DataFrame, batches: DataFrame, at: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """After a restart: inspections in progress fail with one DONE/FAILED event each, batches in progress
    complete. A second sweep changes nothing."""
    stale = F.col("run_status") == "IN_PROGRESS"
    events = inspections.filter(stale).select("inspection_id", F.lit("DONE").alias("stage"), F.lit("FAILED").alias("status"), F.lit(at).cast("timestamp").alias("created_at"))
    fixed = inspections.withColumn("run_status", F.when(stale, "FAILED").otherwise(F.col("run_status")))
    closed = batches.withColumn("status", F.when(F.col("status") == "IN_PROGRESS", "COMPLETED").otherwise(F.col("status")))
    return fixed, closed, events


def search(inspections: DataFrame, limit: int, offset: int = 0, **equal: str) -> DataFrame:
    """Optional equality filters, newest first, a page of the result."""
    for c, v in equal.items():
        inspections = inspections.filter(F.col(c) == v)
    return inspections.orderBy(F.desc("created_at"), "inspection_id").offset(offset).limit(limit)


def report_snapshot(checks: DataFrame, key: str = "inspection_id") -> DataFrame:
    """Per inspection the rule snapshot as one JSON text."""
    rows = F.array_sort(F.collect_list(F.struct("rule_key", "status")))
    return checks.groupBy(key).agg(F.to_json(F.struct(rows.alias("rules"))).alias("snapshot"))


def versioned_snapshot(checks: DataFrame, key: str = "inspection_id") -> DataFrame:
    """Per inspection, as one JSON text, the rule versions that its checks used, by key: rule_key, version_number,
    rule_reference, source_document, source_index (the document's place among those of the report, by first mention) and
    source_locator. An inspection has a check a rule, so its list is as long as the rule set."""
    rows = F.array_sort(F.collect_list(F.struct("rule_key", "version_number", "rule_reference", "source_document", "source_locator")))
    own = checks.groupBy(key).agg(rows.alias("rows")).withColumn("documents", F.array_distinct(F.transform("rows", lambda r: r["source_document"])))
    index = lambda r: F.array_position("documents", r["source_document"])
    full = F.transform("rows", lambda r: F.struct(r["rule_key"].alias("rule_key"), r["version_number"].alias("version_number"), r["rule_reference"].alias("rule_reference"), r["source_document"].alias("source_document"), index(r).alias("source_index"), r["source_locator"].alias("source_locator")))
    return own.select(key, F.to_json(F.struct(full.alias("rules"))).alias("snapshot"))


def nested_documents(parents: DataFrame, key: str = "inspection_id", **children: DataFrame) -> DataFrame:
    """One row per parent with an array of structs for each child table, in the order of the child's columns (but the key).

    Parents and children are one tagged union and meet in one aggregation, whatever the number of child tables. A parent
    without children of a kind has an empty array; children without a parent, or without a key, are left out, as are parents
    without a key. Equal children are all kept. Deeper trees nest the children first. A document is one row, so a
    parent's children have to fit into a row."""
    kinds = {"_parent": parents, **children}

    def tagged(name: str, df: DataFrame) -> DataFrame:
        return df.filter(F.col(key).isNotNull()).select(key, F.struct(*[c for c in df.columns if c != key]).alias(name))

    union = None
    for name, df in kinds.items():
        one = tagged(name, df)
        union = one if union is None else union.unionByName(one, allowMissingColumns=True)
    arrays = [F.array_sort(F.collect_list(name)).alias(name) for name in children]
    found = union.groupBy(key).agg(F.any_value("_parent", True).alias("_parent"), *arrays).filter("_parent IS NOT NULL")
    return found.select(key, "_parent.*", *children)
