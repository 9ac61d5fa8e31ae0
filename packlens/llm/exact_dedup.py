"""Exact deduplication by 128-bit content hash with a byte comparison inside hash groups.

Only DataFrame functions are used. The text is shuffled once, after map-side combining: the
aggregate's key is (hash, normalised text), so equal texts of one task collapse before the exchange
and a group that holds a third of all rows arrives as one row per task. Two texts under one hash are
two keys, which is the byte comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, helper, without


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "largest",
    content_hash: Callable[[Column], Column] = md5_128,
) -> DataFrame:
    """One row per input row: `id_col`, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty, so null and
    empty texts form one group. keep is "largest" or "smallest" id. Null ids never win over others; in
    a group of null ids only, keep_id is null and its rows are kept. Rows that repeat the kept id
    within a group are the same document and are all kept. An empty table gives an empty result;
    other columns of docs are ignored, whatever their names.
    """
    pick = F.max if keep == "largest" else F.min
    base = docs.select(F.col(id_col).alias("__id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("__norm"))
    rows = cut(base.select("__id", content_hash(F.col("__norm")).alias("__h"), F.unhex(F.sha2("__norm", 256)).alias("__sha")), "hashes")
    texts = base.groupBy(content_hash(F.col("__norm")).alias("__h"), "__norm").agg(pick("__id").alias("keep_id"), F.count("*").alias("group_size"))
    heads = cut(
        texts.groupBy("__h").agg(F.count("*").alias("__texts"), pick("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")), "groups"
    )
    found = rows.join(heads.filter("__texts = 1").drop("__texts"), "__h")
    collided = heads.filter("__texts > 1").select("__h")
    if not collided.isEmpty():  # different texts under one hash: settle those hashes by the text itself
        again = base.withColumn("__h", content_hash(F.col("__norm"))).join(collided, "__h", "left_semi")
        parts = again.groupBy("__h", "__norm").agg(pick("__id").alias("keep_id"), F.count("*").alias("group_size"))
        settled = again.join(parts, ["__h", "__norm"]).select("__h", "__id", F.unhex(F.sha2("__norm", 256)).alias("__sha"), "keep_id", "group_size")
        found = found.unionByName(settled)
    return found.select(
        F.col("__id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("__id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("__sha")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of docs that exact_groups keeps, all columns unchanged, whatever their names. An id that occurs with several
    texts is dropped only where its text loses."""
    sha = helper(docs, "sha")
    gone = exact_groups(docs, id_col, text_col, keep).filter(~F.col("kept")).select(F.col(id_col).alias("gone_id"), F.unhex("text_sha256").alias("gone_sha"))
    with_sha = docs.withColumn(sha, F.unhex(F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256)))
    return without(with_sha, cut(gone.distinct(), "gone"), [id_col, sha]).drop(sha)
