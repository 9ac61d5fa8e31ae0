"""Importance resampling towards a target corpus, with hashed n-gram features.

Weights are scored by arrays: the features of the corpus and of the target are counted in a fixed number of
buckets, each bucket's log ratio is one element of an array, and a document's weight is the sum of the
elements at its features. Gumbel noise that depends on the id alone turns a draw without replacement
in proportion to the weights into taking the highest scores.

The cutoff among those scores is found without sorting all of them. A quantile sketch proposes a bracket of
scores, exact counts outside it say whether the cutoff is inside, and the bracket is widened until it
is. Only the bracket's rows are sorted. Ranks are given to the drawn rows alone, by ranges.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut
from .ranked import part_counts, sorted_parts

BUCKETS = 10_000
#: Everything in ASCII but digits and lower-case letters separates words.
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FAR = 1 << 62


def words(text: Column) -> Column:
    """Lower-cased (A-Z only) runs of digits, letters and whatever is not ASCII; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _BREAKS), "")


def features(tokens: Column, longest: int) -> Column:
    """All runs of 1 to `longest` words, joined by one space, repeats kept."""

    def of(n: int) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))
        return F.when(F.size(tokens) >= n, some).otherwise(F.array().cast("array<string>"))

    return tokens if longest == 1 else F.concat(tokens, *[of(n) for n in range(2, longest + 1)])


def bucket(feature: Column, buckets: int) -> Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def bucket_counts(df: DataFrame, text_col: str, longest: int, buckets: int) -> np.ndarray:
    """Features in each bucket over all rows. The driver gets one number a bucket."""
    tokens = df.select(words(F.col(f"`{text_col}`")).alias("w"))
    each = tokens.select(F.explode(features(F.col("w"), longest)).alias("f")).groupBy(bucket(F.col("f"), buckets).alias("b")).count()
    out = np.zeros(buckets, np.int64)
    for r in each.collect():
        out[r["b"]] = r["count"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) for each of the B buckets."""
    b = len(source)
    ratio = (target + 1.0) * (source.sum() + float(b)) / ((source + 1.0) * (target.sum() + float(b)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def noise(identity: Column, seed: str) -> Column:
    """Gumbel noise times 1000, rounded down, from the first 32 bits of sha256(seed:id)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(identity.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def scored(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str, longest: int, seed: str) -> DataFrame:
    """id, n_features, weight, score and words of each row. The array of gains is a constant of the plan."""
    array = F.from_json(F.lit(str(gain.tolist())), "array<bigint>")
    tokens = docs.select(F.col(f"`{id_col}`").alias("id"), words(F.col(f"`{text_col}`")).alias("w"))
    found = tokens.select("id", F.size("w").cast("bigint").alias("n_words"), features(F.col("w"), longest).alias("f"))
    total = F.aggregate("f", F.lit(0).cast("bigint"), lambda a, x: a + F.get(array, bucket(x, len(gain))))
    out = found.select("id", "n_words", F.size("f").cast("bigint").alias("n_features"), total.alias("weight"))
    return out.withColumn("score", F.col("weight") + noise(F.col("id"), seed))


def _order() -> list[Column]:
    return [F.col("score").desc(), F.col("id").asc_nulls_last()]


def bracket(pool: DataFrame, rows: int, wanted: int, accuracy: int) -> tuple[int, int, int]:
    """(lo, hi, above): scores from lo to hi hold the wanted-th highest of the pool, `above` are higher than hi. The
    sketch only proposes: exact counts decide, and a bracket that misses is made four times as wide."""
    share, width = 1 - wanted / rows, 2 / accuracy
    while True:
        if width >= 1:
            lo, hi = -_FAR, _FAR
        else:
            lo, hi = pool.select(F.percentile_approx("score", [max(0.0, share - width), min(1.0, share + width)], accuracy)).first()[0]
        s = F.col("score")
        above, inside = pool.agg(F.count_if(s > hi), F.count_if(s.between(lo, hi))).first()
        if above < wanted <= above + inside:
            return lo, hi, above
        width *= 4


def cutoff(pool: DataFrame, rows: int, wanted: int, accuracy: int) -> tuple:
    """(score, id) of the wanted-th row of the pool in the order of scores, ties by id."""
    lo, hi, above = bracket(pool, rows, wanted, accuracy)
    parts = sorted_parts(pool.filter(F.col("score").between(lo, hi)).select("score", "id"), _order(), "bracket")
    left = wanted - above - 1
    part, before, _ = next(p for p in part_counts(parts) if p[1] <= left < p[1] + p[2])
    at = parts.filter((F.col("part") == part) & (F.col("row") == left - before)).first()
    return at["score"], at["id"]


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    longest: int = 1,
    buckets: int = BUCKETS,
    percent: int = 10,
    least_words: int = 20,
    seed: str = "2024",
    accuracy: int = 10_000,
) -> DataFrame:
    """One row per row of docs: id, n_features, weight, score, rank (null where it isn't drawn).

    Of the N rows with at least `least_words` words, floor(percent * N / 100) with the highest scores are drawn,
    ties to the smaller id. Null and empty texts have no features, weight 0 and are never drawn unless least_words is 0.
    Rows that share an id share their noise and are rows of their own; equal rows at the cutoff are interchangeable, and as
    many are drawn as fit. A null id has the noise of an empty one and loses every tie. Texts of any length are read
    whole; other columns are ignored, whatever their names. An empty table gives an empty result, an empty target weighs by
    rarity alone. The driver holds one number a bucket and one a shuffle partition.
    """
    gain = gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, target_text_col, longest, buckets))
    rows = cut(scored(docs, gain, id_col, text_col, longest, seed), "scored")
    pool = rows.filter(F.col("n_words") >= least_words)
    n = pool.count()
    wanted = n * percent // 100
    names = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    if wanted == 0:
        return rows.select(*names, F.lit(None).cast("bigint").alias("rank"))
    score, last = cutoff(pool, n, wanted, accuracy)
    tie = F.lit(True) if last is None else F.col("id") <= F.lit(last)
    drawn = F.coalesce((F.col("n_words") >= least_words) & ((F.col("score") > score) | ((F.col("score") == score) & tie)), F.lit(False))
    parts = sorted_parts(rows.filter(drawn), _order(), "drawn")
    starts = {p: before for p, before, _ in part_counts(parts)}
    place = F.get(F.from_json(F.lit(str([starts.get(p, 0) for p in range(max(starts) + 1)])), "array<bigint>"), F.col("part").cast("int")) + F.col("row") + 1
    ranked = parts.select(*names, F.when(place <= wanted, place).alias("rank"))
    return ranked.unionByName(rows.filter(~drawn).select(*names, F.lit(None).cast("bigint").alias("rank")))
