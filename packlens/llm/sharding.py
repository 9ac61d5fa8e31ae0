"""Sharding by vector bin packing: bytes, tokens and rows are balanced together.

Rows with equal texts are a group and stay together. A group with more than 1/buckets of all bytes, tokens or
rows is placed as itself; there are at most 3 * buckets of these. Smaller groups are gathered, whole, into
`buckets` bundles by a hash of the text, which bounds what is placed at any size of the table. The driver sees these
sums only and places them, largest first, where the dot product with the residual capacity is highest.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut


def place(loads: np.ndarray, shards: int, weights: tuple[float, ...]) -> np.ndarray:
    """Shard of each row of loads (bytes, tokens, rows). The residual capacity of a shard is what is
    missing to an equal part; ties go to the lowest shard."""
    unit = loads / np.maximum(loads.sum(0), 1) * np.array(weights)
    residual = np.tile(unit.sum(0) / shards, (shards, 1))
    out = np.zeros(len(loads), np.int64)
    for i in np.argsort(-loads[:, 0], kind="stable"):
        out[i] = s = int((residual @ unit[i]).argmax())
        residual[s] -= unit[i]
    return out


def shard(
    docs: DataFrame,
    shards: int = 8,
    buckets: int = 16_384,
    grain: int = 64,
    weights: tuple[float, float, float] = (1.0, 0.5, 0.25),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard, tokens.

    size is the UTF-8 bytes of the text plus 1, a null text has none; a null text and an empty one are one
    group. law is "bytes": sizes per shard are near equal; weights say how much bytes, tokens and rows count. Only
    a group that alone exceeds an equal part of a shard in one of the three, and so fits into none, is split, into the
    fewest parts that fit. Groups above 1/grain of a shard's part are numbered in several tasks.

    slot numbers a shard's rows from 0 without gaps; rows that repeat, and rows with a null id, get slots of
    their own. Texts of any length are read whole, other columns are ignored, whatever their names, and an empty
    table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("bigint").alias("tokens"),
            F.xxhash64(text).alias("h"),
        ),
        "sizes",
    )
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")]
    total = rows.agg(*[F.coalesce(s, F.lit(0)).alias(n) for s, n in zip(sums, ("size", "tokens", "n"), strict=True)]).first()
    most = F.greatest(*[F.col(c) / F.lit(max(1, total[c])) for c in ("size", "tokens", "n")])
    groups = rows.groupBy("h").agg(*sums).withColumn("most", most).filter(F.col("most") * buckets > 1)
    torn = F.greatest(F.lit(1), F.ceil(F.col("most") * shards))
    large = groups.select("h", torn.alias("torn"), (torn * F.ceil(F.col("most") * shards * grain / torn)).alias("parts"))
    own, salt = F.col("h").cast("string"), F.pmod(F.xxhash64("id", F.lit("part")), F.col("parts"))
    bucket = F.pmod("h", F.lit(buckets)).cast("string")
    alone = F.col("parts").isNotNull()
    keyed = rows.join(F.broadcast(large), "h", "left").select(  # at most 3 * buckets rows, by the shares
        "id", "size", "text_crc32", "tokens",
        F.when(alone, F.concat_ws("/", own, salt.cast("string"))).otherwise(bucket).alias("bundle"),
        F.when(alone, F.concat_ws("/", own, (salt % F.col("torn")).cast("string"))).otherwise(bucket).alias("unit"),
    )
    keyed = cut(keyed, "bundles")
    bundles = keyed.groupBy("unit", "bundle").agg(*sums).toPandas().sort_values(["unit", "bundle"], kind="stable").reset_index(drop=True)
    units = bundles.groupby("unit", sort=True)[["size", "tokens", "n"]].sum()
    where = dict(zip(units.index, place(units.to_numpy(float), shards, weights).tolist(), strict=True))
    bundles["shard"] = bundles["unit"].map(where)
    bundles["base"] = bundles.groupby("shard")["n"].cumsum() - bundles["n"] if len(bundles) else 0
    found = docs.sparkSession.createDataFrame(
        list(bundles[["bundle", "shard", "base"]].itertuples(index=False, name=None)), "bundle string, shard int, base bigint"
    )
    order = Window.partitionBy("bundle").orderBy("id", "size", "text_crc32")
    return keyed.join(F.broadcast(found), "bundle").select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("base") + F.row_number().over(order) - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "tokens",
    )
