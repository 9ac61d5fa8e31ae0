"""Temporal URL filter: dated list entries become validity intervals and an as-of join asks, for every
capture, which entries were active when it was fetched. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, maybe_broadcast

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-cased host; empty for null and for texts that are no absolute URL."""
    return F.rtrim(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1)), F.lit("."))


def validity(entries: DataFrame) -> DataFrame:
    """(kind, pattern, since, until) from dated entries (kind, pattern, action, at).

    An "add" holds until the next entry of the same pattern, for ever if there is none. At one instant
    removals count after additions. Entries with a null in any column used are void.
    """
    e = entries.select("kind", F.lower("pattern").alias("pattern"), "action", "at").dropna().distinct()
    later = Window.partitionBy("kind", "pattern").orderBy("at", F.when(F.col("action") == "remove", 1).otherwise(0), "action")
    e = e.withColumn("until", F.lead("at").over(later))
    return e.filter((F.col("action") == "add") & (F.col("until").isNull() | (F.col("until") > F.col("at")))).select(
        "kind", "pattern", F.col("at").alias("since"), "until"
    )


def lookup_keys(url: Column) -> Column:
    """array<struct<kind,pattern>>: the host, every domain it lies in, and every path prefix of the URL."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern"))
    )
    segments = F.filter(F.split(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _PATH, 1)), "/"), lambda x: x != "")
    prefixes = F.when(F.size(segments) == 0, F.array().cast("array<struct<kind:string,pattern:string>>")).otherwise(
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(segments), F.lit(1))),
            lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i), "/")).alias("pattern")),
        )
    )
    exact = F.array(F.struct(F.lit("host").alias("kind"), host.alias("pattern")))
    return F.when(host == "", F.array().cast("array<struct<kind:string,pattern:string>>")).otherwise(F.concat(exact, domains, prefixes))


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", at_col: str = "fetched_at") -> DataFrame:
    """One row per capture: id, host, blocked, n_entries (active patterns that it meets), first_pattern.

    Captures without a URL or fetch time meet nothing and pass. Repeated captures get equal rows, null ids too. URLs
    of any length are read whole; an empty list blocks nothing and no captures give no rows; other columns are
    ignored, whatever their names. Hosts and paths are compared in lower case, and a final dot of a host is dropped. The
    list is broadcast if its counted intervals are few; otherwise the join shuffles and Spark splits
    hot hosts. Only captures that meet an entry are shuffled for the count per capture.
    """
    spans = cut(validity(entries), "validity")
    rows = captures.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"), F.col(at_col).alias("__at"))
    keys = rows.filter(F.col("__at").isNotNull() & F.col("__url").isNotNull()).select("__id", "__url", "__at", F.inline_outer(lookup_keys(F.col("__url"))))
    met = keys.join(maybe_broadcast(spans, spans.count()), ["kind", "pattern"]).filter(
        (F.col("__at") >= F.col("since")) & (F.col("until").isNull() | (F.col("__at") < F.col("until")))
    )
    per = met.groupBy("__id", "__url", "__at").agg(
        F.count_distinct("kind", "pattern").alias("n_entries"), F.min(F.concat_ws(":", "kind", "pattern")).alias("first_pattern")
    )
    per = per.withColumnsRenamed({"__id": "__id2", "__url": "__url2", "__at": "__at2"})
    same = F.col("__id").eqNullSafe(F.col("__id2")) & (F.col("__url") == F.col("__url2")) & (F.col("__at") == F.col("__at2"))
    n = F.coalesce(F.col("n_entries"), F.lit(0).cast("bigint"))
    return rows.join(per, same, "left").select(
        F.col("__id").alias(id_col), host_of(F.col("__url")).alias("host"), (n > 0).alias("blocked"), n.alias("n_entries"), "first_pattern"
    )
