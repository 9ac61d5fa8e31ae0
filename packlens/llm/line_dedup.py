"""Line deduplication on a suffix array over line ids, built by distributed prefix doubling.

A document is the sequence of its non-blank lines. Level 0 ranks the lines that occur more than once;
level k+1 ranks the pairs (rank at i, rank at i + 2^k), again only those that occur more than once. A
line that occurs once, or the end of a document, ends any repeated run, so a suffix leaves the work as
soon as its prefix is unique. Positions of equal rank at level k are a longest-common-prefix interval
of depth 2^k or more. In every interval the first position (by id, then row, then line) stays and the
others are later copies. The windows of later copies cover exactly the repeated runs of at least
2^k lines: such a run is covered by two overlapping windows whose lengths are powers of two.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, helper


def _ranked(groups: DataFrame, within: list[str], by: list[str], bucket: Column) -> DataFrame:
    """groups with `before`: the sum of n over smaller `by` in the same `within`. Sums per bucket come first,
    so that no task sorts more than a bucket of one `within`."""
    g = groups.withColumn("bucket", bucket)
    sums = g.groupBy(*within, "bucket").agg(F.sum("n").alias("in_bucket"))
    prior = Window.partitionBy(*(within or [F.lit(0)])).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("earlier", F.coalesce(F.sum("in_bucket").over(prior), F.lit(0))).drop("in_bucket")
    inner = Window.partitionBy(*within, "bucket").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("inner", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(sums, [*within, "bucket"])
    return g.withColumn("before", F.col("earlier") + F.col("inner")).drop("bucket", "earlier", "inner")


def numbered_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(id, row, n_lines, i, j, h1, h2, words): the i-th of n_lines non-blank lines, at index j of all lines of
    the text. A document without such lines has one row, with i null."""
    src = docs.select(F.col(id_col).alias("id"), (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"), F.split(F.coalesce(text_col, F.lit("")), "\n").alias("lines"))
    idx = F.filter(F.transform("lines", lambda x, j: F.struct(j.alias("j"), x.alias("line"))), lambda s: F.trim(s["line"]) != "")
    src = src.select("id", "row", F.size(idx).cast("bigint").alias("n_lines"), F.posexplode_outer(idx).alias("i", "s"))
    line = F.col("s")["line"]
    return src.select(
        "id", "row", "n_lines", "i", F.col("s")["j"].alias("j"), F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"),
        F.size(F.filter(F.split(line, r"\s+"), lambda w: w != "")).alias("words"),
    )


def suffix_levels(lines: DataFrame) -> list[DataFrame]:
    """Level by level the positions (id, row, i, words, rank, n) whose prefix of 2^k lines occurs n > 1 times;
    rank is the number of smaller such prefixes, so it orders them."""
    groups = cut(lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1"), "repeated")
    ranks = _ranked(groups, [], ["h1", "h2"], F.shiftright("h1", 52))
    level = cut(lines.join(ranks, ["h1", "h2"]).select("id", "row", "i", "words", F.col("before").alias("rank"), "n"), "level0")
    out, step = [], 1
    left = level.count()
    width = max(1, left // 1024)
    while left:
        out.append(level)
        second = level.select("row", (F.col("i") - step).alias("i"), F.col("rank").alias("second"))
        both = level.drop("n").join(second, ["row", "i"])
        groups = both.groupBy("rank", "second").agg(F.count("*").alias("n")).filter("n > 1")
        ranks = _ranked(groups, ["rank"], ["second"], F.floor(F.col("second") / width))
        level = both.join(ranks, ["rank", "second"]).select("id", "row", "i", "words", (F.col("rank") + F.col("before")).alias("rank"), "n")
        level, step = cut(level, f"level{len(out)}"), 2 * step
        left = level.count()
    return out


def repeated_runs(lines: DataFrame, min_words: int, shared_by: int | None = None, shared_words: int = 3) -> DataFrame:
    """(row, i, j, depth): the lines to delete. They lie in a run of two or more lines that occurs before, or
    are single lines that occur before and have at least min_words words, or at least shared_words words and
    stand in at least shared_by rows; depth is the largest 2^k seen there."""
    levels = [lv.withColumn("k", F.lit(k)) for k, lv in enumerate(suffix_levels(lines))]
    if not levels:
        return lines.limit(0).select("row", "i", "j", F.lit(0).cast("bigint").alias("depth"))
    every = reduce(DataFrame.union, levels)
    place = F.struct(F.col("id").isNull().alias("none"), "id", "row", "i")
    first = every.groupBy("k", "rank").agg(F.min(place).alias("first"))
    alone = F.col("words") >= min_words
    if shared_by is not None:  # rows per line: first by line and row, so that no task counts a common line alone
        spread = levels[0].select("rank", "row").distinct().groupBy("rank").agg(F.count("*").alias("rows")).filter(F.col("rows") >= shared_by)
        first = first.join(spread.select(F.lit(0).alias("k"), "rank", F.lit(True).alias("shared")), ["k", "rank"], "left")
        alone = alone | (F.col("shared") & (F.col("words") >= shared_words))
    later = every.join(first, ["k", "rank"]).filter(place != F.col("first")).filter((F.col("k") > 0) | alone)
    covers = F.when(F.col("k") == 1, F.array("i", F.col("i") + 1)).otherwise(F.array("i"))  # deeper windows lie within those of depth 2
    found = later.select("row", F.explode(covers).alias("i"), F.expr("shiftleft(1, k)").alias("depth"))
    return found.groupBy("row", "i").agg(F.max("depth").cast("bigint").alias("depth")).join(lines.select("row", "i", "j"), ["row", "i"])


def dedup_lines(
    docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text", shared_by: int | None = None, shared_words: int = 3, row_col: str | None = None
) -> DataFrame:
    """One row per input row: id, n_lines (non-blank), n_deleted, n_runs, longest_run, max_depth, and
    deleted, the indices of the lines to delete counted from 0 over all lines of the text.

    A single line counts from min_words words; with shared_by also from shared_words words if it stands in
    that many documents or more, as boilerplate does.

    Null and empty texts have no lines. Blank lines are no part of a sequence and stay. Rows that repeat
    are documents of their own: the later row loses what it repeats. Null ids come after all others. Texts of any
    length are read whole; an empty table gives an empty result; other columns are ignored, whatever their names.
    row_col: a column that numbers the rows, given out under the name row.
    """
    lines = cut(numbered_lines(docs, id_col, text_col, row_col), "lines")
    gone = cut(repeated_runs(lines.filter("i IS NOT NULL"), min_words, shared_by, shared_words), "deleted")
    w = Window.partitionBy("row").orderBy("i")
    runs = gone.withColumn("run", F.col("i") - F.row_number().over(w)).groupBy("row", "run").agg(
        F.count("*").alias("len"), F.max("depth").alias("depth"), F.collect_list("j").alias("js")
    )
    per = runs.groupBy("row").agg(
        F.sum("len").alias("n_deleted"), F.count("*").alias("n_runs"), F.max("len").alias("longest_run"), F.max("depth").alias("max_depth"),
        F.array_sort(F.flatten(F.collect_list("js"))).alias("deleted"),
    )
    rows = lines.filter("i IS NULL OR i = 0").select("id", "row", "n_lines")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    return rows.join(per, "row", "left").select(
        F.col("id").alias(id_col), "n_lines", *[zero(c) for c in ("n_deleted", "n_runs", "longest_run", "max_depth")],
        F.coalesce("deleted", F.array().cast("array<int>")).alias("deleted"), *(["row"] if row_col else []),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with the deleted lines taken out of the texts, all rows and columns kept, those with null or repeated ids too."""
    row, gone_col = helper(docs, "row"), helper(docs, "gone")
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    gone = dedup_lines(rows, id_col=id_col, text_col=text_col, row_col=row, **how).filter("n_deleted > 0")
    gone = cut(gone.select(F.col("row").alias(row), F.col("deleted").alias(gone_col)), "gone")
    left = F.filter(F.transform(F.split(F.col(text_col), "\n"), lambda x, j: F.struct(x.alias("x"), j.alias("j"))), lambda s: ~F.array_contains(gone_col, s["j"]))
    text = F.when(F.col(gone_col).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(left, lambda s: s["x"]), "\n"))
    return rows.join(gone, row, "left").withColumn(text_col, text).select([f"`{c}`" for c in docs.columns])
