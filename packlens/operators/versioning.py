"""Rule-set versions: plan a load against the store and apply it, without deleting anything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType
from pyspark.sql.window import Window

#: The fields of a rule that make up its content, with what stands for a null or a missing column.
CONTENT = {
    "rule_reference": None, "title": None, "description": None, "requirement": None, "applicability": None, "exceptions": None,
    "validation_type": None, "severity": None, "validator_config": "{}", "applicable_categories": "[]", "excluded_categories": "[]",
    "gating_only": "false", "source_document": None, "source_locator": None, "effective_from": None, "effective_until": None, "notes": None,
}
_JSON = ("validator_config", "applicable_categories", "excluded_categories")


def _as_text(rules: DataFrame, name: str) -> Column:
    """A content column as text; JSON, as text or as a value, in one form whatever the order of its keys."""
    if name not in rules.columns:
        return F.lit(CONTENT[name]).cast("string")
    c = F.col(name)
    if name in _JSON or isinstance(rules.schema[name].dataType, (ArrayType, MapType, StructType)):
        text = c if isinstance(rules.schema[name].dataType, StringType) else F.to_json(c, {"ignoreNullFields": "false"})
        c = F.coalesce(F.to_json(F.try_parse_json(text)), text)
        c = F.when(~c.isin("", "null"), c)
    return F.coalesce(c.cast("string"), F.lit(CONTENT[name]).cast("string"))


def with_hash(rules: DataFrame) -> DataFrame:
    """content_hash over the content fields; missing columns count as null."""
    body = F.to_json(F.struct(*[_as_text(rules, c).alias(c) for c in sorted(CONTENT)]))
    return rules.withColumn("content_hash", F.sha2(body, 256))


def plan_load(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """(rule_key, action): created, unchanged, new_version, reactivated, deactivated; inactive keys that stay
    away have no row. store: rule_key, active, version_number, is_current, content_hash."""
    cur = store.filter("is_current").select("rule_key", "active", "version_number", F.col("content_hash").alias("old_hash"))
    j = cur.join(incoming.select("rule_key", F.col("content_hash").alias("new_hash")), "rule_key", "full_outer")
    action = (
        F.when(F.col("old_hash").isNull(), "created")
        .when(F.col("new_hash").isNull(), F.when(F.col("active"), "deactivated"))
        .when(~F.col("active"), "reactivated")
        .when(F.col("old_hash") == F.col("new_hash"), "unchanged")
        .otherwise("new_version")
    )
    return j.select("rule_key", action.alias("action"), "version_number", (F.col("old_hash") == F.col("new_hash")).alias("same")).filter("action IS NOT NULL")


def apply_load(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """The store after the load: changed content becomes version n + 1 and the only current one; keys that are
    gone turn inactive; versions are never deleted. Loading twice changes nothing more."""
    plan = plan_load(store, incoming).select("rule_key", "action", F.coalesce("same", F.lit(False)).alias("same"), F.col("version_number").alias("last"))
    old = store.join(plan, "rule_key", "left")
    newer = (F.col("action").isin("new_version", "reactivated")) & ~F.col("same")
    kept = old.withColumns(
        {
            "is_current": F.when(F.coalesce(newer, F.lit(False)), False).otherwise(F.col("is_current")),
            "active": F.when(F.col("action") == "deactivated", False).when(F.col("action") == "reactivated", True).otherwise(F.col("active")),
        }
    ).select(store.columns)
    fresh = incoming.join(plan.filter((F.col("action") == "created") | (F.col("action").isin("new_version", "reactivated") & ~F.col("same"))), "rule_key")
    fresh = fresh.withColumns({"active": F.lit(True), "is_current": F.lit(True), "version_number": F.coalesce(F.col("last"), F.lit(0)) + 1})
    return kept.unionByName(fresh.select(store.columns))


def current_rules(store: DataFrame) -> DataFrame:
    return store.filter("is_current AND active")


def history(loads: DataFrame) -> DataFrame:
    """Validity intervals of rule versions from whole rule sets loaded one after another.

    loads: rule_key, loaded_at and content_hash, one row for each rule of each load, and columns of the content, which are
    kept. Result: rule_key, version_number, valid_from, valid_until (null: still valid) and the content. A changed hash is the
    key's next version; a load without the key ends it; a key that comes back with its last content has the same version in a
    new interval. One window a key over its loads; only the load times, a row each, are numbered together.
    """
    content = [c for c in loads.columns if c not in ("rule_key", "loaded_at", "content_hash")]
    times = loads.select("loaded_at").distinct()
    times = times.withColumn("load", F.row_number().over(Window.orderBy("loaded_at"))).select("loaded_at", "load")
    ends = times.select((F.col("load") - 1).alias("last"), F.col("loaded_at").alias("valid_until"))
    along = Window.partitionBy("rule_key").orderBy("load")
    before = F.lag("content_hash").over(along)
    steps = loads.join(F.broadcast(times), "loaded_at")  # a row a load
    steps = steps.withColumns({"changed": F.coalesce(~before.eqNullSafe(F.col("content_hash")), F.lit(True)) | before.isNull(), "gap": F.coalesce(F.col("load") - F.lag("load").over(along) > 1, F.lit(False))})
    running = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = steps.withColumns({"version_number": F.sum(F.col("changed").cast("int")).over(running).cast("int"), "run": F.sum((F.col("changed") | F.col("gap")).cast("int")).over(running)})
    runs = steps.groupBy("rule_key", "version_number", "run").agg(F.min("loaded_at").alias("valid_from"), F.max("load").alias("last"), *[F.first(c).alias(c) for c in content])
    return runs.join(F.broadcast(ends), "last", "left").select("rule_key", "version_number", "valid_from", "valid_until", *content)


#: Intervals that are broadcast at most; beyond it the join shuffles by rule and adaptive execution splits hot rules.
BROADCAST_INTERVALS = 200_000


def as_of(rows: DataFrame, intervals: DataFrame, at: str) -> DataFrame:
    """rows (with rule_key and the time `at`) with the version that was valid then; rows of rules that weren't are left out."""
    i = intervals.withColumnsRenamed({"rule_key": "_rule", "valid_from": "_from", "valid_until": "_until"})
    i = F.broadcast(i) if intervals.count() <= BROADCAST_INTERVALS else i
    valid = (F.col("rule_key") == F.col("_rule")) & (F.col(at) >= F.col("_from")) & (F.col("_until").isNull() | (F.col(at) < F.col("_until")))
    return rows.join(i, valid).drop("_rule", "_from", "_until")
