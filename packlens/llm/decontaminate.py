"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, names and units become typed placeholders, so that a question with other numbers or names
has the same template. Windows of the templates are hash-joined; aligned windows of one document and
one item are counted, and the values in the placeholders must map consistently. Beside the templates,
windows of the lower-cased words themselves are joined, which finds copies in another case and
items made mostly of numbers and names. A document's windows of both kinds are made in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, maybe_broadcast, without

#: Unit words that turn into a placeholder after a number.
UNITS = "kg|g|mg|lb|lbs|km|m|cm|mm|ft|miles?|meters?|metres?|l|ml|litres?|liters?|hours?|hrs?|minutes?|mins?|seconds?|days?|weeks?|months?|years?|dollars?|cents?|euros?|percent"
NAME, NUMBER, UNIT = "~", "#", "^"
TEMPLATE, EXACT, WHOLE = 0, 1, 2


def plain_text(text: Column) -> Column:
    """text without punctuation, but for what stands before a digit, which is part of a number. This and the patterns
    below begin with a class of characters, so that they fail fast."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}\s.,:]+|[.,:]+(?!\p{Nd})", "")


def value_text(plain: Column) -> Column:
    """plain text with runs of capitalised words joined to one word each: a name of several words is one value."""
    return F.regexp_replace(plain, r"(\p{Lu}\p{L}*)\s+(?=\p{Lu})", "$1_")


def template_text(values: Column) -> Column:
    """Lower-cased text with placeholders, from a value text; it splits into as many words. A name is a capitalised
    word or a run of them, at the start of a sentence too, as names stand there as well."""
    named = F.regexp_replace(values, r"\p{Lu}(?<![\p{L}_]\p{Lu})[\p{L}_]*", NAME)
    numbered = F.regexp_replace(named, r"\p{Nd}+(?:[.,:]+\p{Nd}+)*", NUMBER)
    return F.lower(F.regexp_replace(numbered, rf"(?i){NUMBER}(\s)(?:{UNITS})\b", f"{NUMBER}$1{UNIT}"))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _is_slot(w: Column) -> Column:
    return w.isin(NAME, NUMBER, UNIT)


def word_hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.xxhash64(w))


def _windows(toks: DataFrame, hashes: dict[int, str], widths: list[int], least: int) -> DataFrame:
    """(id, pos, h): all windows of the given widths over each kind's column of word hashes; kind and width are part of
    h, which is null where a window would pass the end. A text of fewer than `least` words, which no width is below, is
    one window of its own. Rows are made one by one in generated code: arrays of windows would be interpreted, and as
    large as many copies of the text."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("a")) for k, c in hashes.items()])
    every = toks.select("id", F.inline_outer(kinds)).select("*", F.explode_outer(F.sequence(F.lit(0), F.size("a"))).alias("pos"))
    at = lambda n: F.when(F.col("pos") + n <= F.size("a"), F.xxhash64("kind", F.lit(n), *[F.get("a", F.col("pos") + j) for j in range(n)]))
    whole = F.when((F.col("kind") == EXACT) & (F.col("pos") == 0) & (F.size("a") < least), F.xxhash64(F.lit(WHOLE), F.size("a"), "a"))
    return every.select("id", "pos", F.explode_outer(F.array(F.coalesce(at(widths[0]), whole), *[at(n) for n in widths[1:]])).alias("h"))


def benchmark_windows(bench: DataFrame, item_col: str, text_col: str, width: int, literals: int, least: int) -> DataFrame:
    """(h, kind, width, item_id, item_pos, slotted, total): windows of the template with at least `literals` words that
    are no placeholders, and all windows of the words; items shorter than width are one window of their own
    length. Of an item with fewer than `least` words there is only its whole sequence of words, of kind EXACT. total: the windows of one kind that the item has."""
    plain = plain_text(F.col(text_col))
    t = bench.select(F.col(item_col).alias("item_id"), words(template_text(value_text(plain))).alias("t"), words(F.lower(plain)).alias("x")).dropna(subset=["item_id"])
    t = t.select("item_id", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("t")) for k, c in ((TEMPLATE, "t"), (EXACT, "x"))])))
    short = t.filter((F.col("kind") == EXACT) & F.size("t").between(1, least - 1))
    short = short.select(F.xxhash64(F.lit(WHOLE), F.size("t"), word_hashes(F.col("t"))).alias("h"), "kind", F.lit(width).alias("width"), "item_id", F.lit(0).alias("item_pos"), F.lit(False).alias("slotted"))
    t = t.withColumn("width", F.least(F.lit(width), F.size("t"))).filter(F.col("width") >= least)
    w = t.select("item_id", "kind", "t", "width", F.explode(F.sequence(F.lit(0), F.size("t") - F.col("width"))).alias("item_pos"))
    w = w.withColumn("win", F.slice("t", F.col("item_pos") + 1, F.col("width"))).withColumn("slots", F.size(F.filter("win", _is_slot)))
    w = w.filter((F.col("kind") == EXACT) | (F.col("width") - F.col("slots") >= literals))
    w = w.select(F.xxhash64("kind", "width", word_hashes(F.col("win"))).alias("h"), "kind", "width", "item_id", "item_pos", (F.col("slots") > 0).alias("slotted")).unionByName(short).distinct()
    total = w.groupBy("item_id", "kind").agg(F.count_distinct("item_pos").alias("total"))
    return w.join(total, ["item_id", "kind"])


def find_leaks(
    docs: DataFrame,
    bench: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 8,
    literals: int = 3,
    enough: int = 6,
    share: float = 0.5,
    least: int = 4,
) -> DataFrame:
    """One row per (document id, item) that leaks: id, item_id, n_windows, n_total, coverage, exact, consistent.

    A pair leaks if one alignment of the item in the document has at least min(enough, share of the
    item's windows) matching windows: windows of words, or windows of the template with either
    placeholders that map consistently (one value of the item never stands for two values of the document)
    or so many windows without placeholders. The columns tell of the alignment with the largest coverage; exact: all
    its placeholder values agree.

    An item of fewer than `least` words (at most width), such as a one-word answer, leaks only in a text that is, but for
    case and punctuation, that item and nothing else: inside other texts such words stand by chance.

    Null or empty texts leak nothing; null ids on either side are left out; rows that share an id are
    judged together. Whole texts are read, whatever their length. An empty table on either side gives an empty result;
    other columns are ignored, whatever their names.
    """
    least = max(1, min(least, width))
    bw = cut(benchmark_windows(bench, item_col, item_text_col, width, literals, least), "benchmark")
    keyed = maybe_broadcast(bw.select("h", "kind", "item_id", "item_pos", "slotted", "total"), bw.count())
    base = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    plain = base.select("id", plain_text(F.col("text")).alias("plain"))
    toks = plain.select("id", word_hashes(words(template_text(value_text(F.col("plain"))))).alias("t"), word_hashes(words(F.lower("plain"))).alias("x"))
    widths = [r["width"] for r in bw.select("width").distinct().collect()] or [width]  # at most `width` values
    met = _windows(toks, {TEMPLATE: "t", EXACT: "x"}, widths, least).join(keyed, "h")
    lines = met.groupBy("id", "item_id", "kind", (F.col("pos") - F.col("item_pos")).alias("delta"), "total").agg(
        F.count_distinct("item_pos").alias("n"), F.count_distinct(F.when(~F.col("slotted"), F.col("item_pos"))).alias("free")
    )
    need = F.greatest(F.lit(1), F.least(F.lit(enough), F.ceil(F.col("total") * share)))
    near = cut(lines.filter(F.col("n") >= need).withColumn("need", need), "aligned")
    by_words = near.filter(F.col("kind") == EXACT).withColumns({"exact": F.lit(True), "consistent": F.lit(True)})
    near = near.filter(F.col("kind") == TEMPLATE)
    ids = near.select("id").distinct()
    texts = base.join(maybe_broadcast(ids, ids.count()), "id").select("id", value_text(plain_text(F.col("text"))).alias("v"))
    texts = texts.select("id", words(template_text(F.col("v"))).alias("dt"), words(F.lower("v")).alias("dv"))
    items = bench.select(F.col(item_col).alias("item_id"), value_text(plain_text(F.col(item_text_col))).alias("v"))
    items = items.select("item_id", words(template_text(F.col("v"))).alias("it"), words(F.lower("v")).alias("iv"))
    both = near.join(texts, "id").join(items, "item_id")
    pairs = F.filter(
        F.transform(
            F.sequence(F.lit(0), F.size("it") - 1),
            lambda i: F.when(
                _is_slot(F.get("it", i)) & (F.get("dt", i + F.col("delta")) == F.get("it", i)),
                F.struct(F.get("iv", i).alias("a"), F.get("dv", i + F.col("delta")).alias("b")),
            ),
        ),
        lambda x: x.isNotNull(),
    )
    both = both.withColumn("pairs", F.array_distinct(pairs)).withColumn("froms", F.array_distinct(F.transform("pairs", lambda x: x["a"])))
    both = both.withColumn("consistent", F.size("pairs") == F.size("froms")).withColumn("exact", F.forall("pairs", lambda x: x["a"] == x["b"]))
    leak = both.filter(F.col("consistent") | (F.col("free") >= F.col("need"))).select(by_words.columns).union(by_words)
    best = F.struct((F.col("n") / F.col("total")).alias("coverage"), "exact", "consistent", F.col("n").alias("n_windows"), F.col("total").alias("n_total"))
    found = leak.groupBy("id", "item_id").agg(F.max(best).alias("best"))
    return found.select(F.col("id").alias(id_col), "item_id", *[f"best.{c}" for c in ("n_windows", "n_total", "coverage", "exact", "consistent")])


def drop_leaks(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """docs without the documents that leak an item; rows with null ids stay."""
    return without(docs, cut(find_leaks(docs, bench, id_col=id_col, **how).select(id_col).distinct(), "leaks"), [id_col])
