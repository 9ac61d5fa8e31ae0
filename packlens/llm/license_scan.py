"""Licence scan: a trained paragraph classifier over sparse word n-grams, confirmed by templates.

A softmax regression over one- and two-word n-grams is fitted on the driver, on paragraphs made from
the templates below (whole, in parts, with words left out) and on a bounded sample of corpus paragraphs
as the class `unknown`. Its weights are a bounded table. Scoring is DataFrame functions only: the
paragraphs' n-grams meet the table in a broadcast join, weights are summed per paragraph, and a
paragraph has a licence if its probability passes the calibrated threshold and it shares enough
two-word n-grams with the family's template.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut
from .license_templates import TEMPLATES

UNKNOWN = "unknown"
#: Counts of pairs in templates: bits of one, and how many share a 64-bit number.
BITS, PACKED = 10, 6


def _words(text: str) -> list[str]:
    return [w for w in "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in text).split() if w]


def _grams(words: list[str]) -> set[tuple[str, str]]:
    return {(w, "") for w in words} | set(zip(words, words[1:]))


@dataclass
class LicenseModel:
    families: list[str]  # the last is UNKNOWN
    grams: list[tuple[str, str]]
    weights: np.ndarray  # grams x families
    bias: np.ndarray
    threshold: float
    common: list[tuple[str, str]]  # two-word n-grams of the background, which count on neither side of a match
    recall: float = 0.0  # share of held-out licence paragraphs that get their family at the threshold
    false_rate: float = 0.0  # share of held-out background paragraphs that get any family at the threshold


def _altered(words: list[str], rng: np.random.Generator) -> list[str]:
    """A part of a paragraph with some words left out."""
    lo = int(rng.integers(0, max(1, len(words) // 2)))
    part = words[lo : lo + max(3, int(len(words) * 0.7))]
    return [x for x in part if rng.random() > 0.1] or part


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def fit(background: list[str], max_features: int = 6000, rounds: int = 300, ridge: float = 1e-3, false_rate: float = 0.001) -> LicenseModel:
    """Fit on template paragraphs against background paragraphs (the class unknown), at most max_features
    n-grams, those in most paragraphs first.

    Every third background paragraph and four altered copies of each template are held out. The threshold is the
    larger of 0.5 and the highest probability, but for a share of false_rate, that held-out background gets;
    recall and false_rate of the model are measured on what is held out.
    """
    rng = np.random.default_rng(7)
    texts, labels, held, held_labels = [], [], [], []
    for fam, templates in TEMPLATES.items():
        for t in templates:
            w = _words(t)
            texts += [w] * 4 + [_altered(w, rng) for _ in range(12)]
            labels += [fam] * 16
            held += [_altered(w, rng) for _ in range(4)]
            held_labels += [fam] * 4
    split = [_words(t) for t in background]
    behind, apart = [t for i, t in enumerate(split) if i % 3 != 2], split[2::3]
    common, often_in = {}, {}
    for count, group in ((common, behind), (often_in, texts)):
        for w in group:
            for g in _grams(w):
                count[g] = count.get(g, 0) + 1
    often = {g for g, n in common.items() if n > max(3, 0.01 * len(behind))}
    grams = sorted(sorted(often_in.keys() - often), key=lambda g: -often_in[g])[:max_features]
    at = {g: i for i, g in enumerate(grams)}
    families = [*TEMPLATES, UNKNOWN]

    def matrix(groups: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(groups), len(grams)), dtype=np.float32)
        for i, t in enumerate(groups):
            out[i, [at[g] for g in _grams(t) if g in at]] = 1
        return out

    x = matrix([*texts, *behind, []])
    y = np.array([families.index(f) for f in labels] + [len(families) - 1] * (len(behind) + 1))
    one = np.eye(len(families), dtype=np.float32)[y]
    each = (1 / np.maximum(1, np.bincount(y, minlength=len(families))))[y][:, None].astype(np.float32)  # families count alike
    w, b = np.zeros((len(grams), len(families)), dtype=np.float32), np.zeros(len(families), dtype=np.float32)
    for _ in range(rounds):
        d = (_softmax(x @ w + b) - one) * each
        w -= 2.0 * (x.T @ d + ridge * w)
        b -= 2.0 * d.sum(0)
    clean, known = (_softmax(matrix(g) @ w + b) for g in (apart or [[]], held))
    threshold = max(0.5, float(np.quantile(clean[:, :-1].max(1), 1 - false_rate)))
    right = (known.argmax(1) == [families.index(f) for f in held_labels]) & (known.max(1) >= threshold)
    return LicenseModel(families, grams, w, b, threshold, sorted(g for g in often if g[1]), float(right.mean()), float((clean[:, :-1].max(1) > threshold).mean()))


def paragraph_words(paragraph: Column) -> Column:
    return F.filter(F.split(F.lower(paragraph), "[^a-z0-9]+"), lambda w: w != "")


def _keys(words: Column) -> Column:
    one = F.transform(words, lambda w: F.xxhash64(w, F.lit("")))
    two = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - 2, F.lit(0))), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1)))
    return F.array_distinct(F.concat(one, F.when(F.size(words) > 1, two).otherwise(F.array().cast("array<bigint>"))))


def background_sample(docs: DataFrame, max_docs: int, max_paragraphs: int, text_col: str = "text") -> list[str]:
    """At most max_paragraphs paragraphs of at most max_docs documents chosen by a hash, without those that
    speak of licences or rights (which may be licences)."""
    short = docs.select(F.col(text_col).alias("t")).filter(F.length("t").between(1, 20_000)).withColumn("h", F.xxhash64("t"))
    least = [r["h"] for r in short.select("h").distinct().orderBy("h").limit(max_docs).collect()]  # hashes only, so that no task sorts texts
    some = short.filter(F.col("h").isin(least)).dropDuplicates(["h"])
    paras = some.select(F.explode(F.split("t", "\n")).alias("p")).filter(F.length("p") > 0)
    paras = paras.filter(~F.lower("p").rlike("licen[sc]|copyright|rights reserved|permission|warrant|redistribut|spdx"))
    return [r["p"] for r in paras.orderBy(F.xxhash64("p"), "p").limit(max_paragraphs).collect()]


def template_pairs(m: LicenseModel) -> list[tuple[int, set[tuple[str, str]]]]:
    """(family, two-word n-grams of the model) of each template that has any."""
    known = {g for g in m.grams if g[1]}
    every = [(i, _grams(_words(t)) & known) for i, f in enumerate(m.families[:-1]) for t in TEMPLATES[f]]
    return [x for x in every if x[1]]


def model_table(spark: SparkSession, m: LicenseModel) -> DataFrame:
    """(h, w0.. wn, common, paired, t0.. tk): n-gram key, weights, whether it is a common pair and a template's, and which
    templates have it: PACKED templates share a number of BITS bits each, so that a sum of such numbers counts for all."""
    pairs, n = template_pairs(m), len(m.families)
    longest = max((len(s) for _, s in pairs), default=0)
    if longest >= 1 << BITS:
        raise ValueError(f"a template has {longest} pairs of words; {BITS} bits can't count them")
    inside = lambda g: [sum(1 << BITS * i for i, (_, s) in enumerate(pairs[at : at + PACKED]) if g in s) for at in range(0, len(pairs), PACKED)]
    rows = [(a, b, *map(float, m.weights[i]), 0, any(one), *one) for i, (a, b) in enumerate(m.grams) for one in [inside((a, b))]]
    none = [0] * -(-len(pairs) // PACKED)
    rows += [(a, b, *[0.0] * n, 1, False, *none) for a, b in m.common]
    schema = "a string, b string, " + ", ".join(f"w{i} double" for i in range(n)) + ", common int, paired boolean" + "".join(f", t{k} bigint" for k in range(len(none)))
    return spark.createDataFrame(rows, schema).withColumn("h", F.xxhash64("a", "b")).drop("a", "b")


def shares_a_pair(words: Column, table: DataFrame) -> Column:
    """Has a paragraph any pair of neighbouring words that a template has? Without one no template can match, so
    that the paragraph need not be scored. The pairs are the model's, at most max_features."""
    pairs = [r["h"] for r in table.filter("paired").select("h").distinct().collect()]
    two = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.xxhash64(a, b).isin(pairs))
    return F.array_contains(two, True)


def scan(docs: DataFrame, model: LicenseModel, confirm: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_paragraphs (with a licence), families (distinct, by name, joined by commas),
    best_probability, best_match: the two-word n-grams that paragraph and template share, as a share of the smaller of the two, so
    that a part of a template counts as well as a template inside a longer line. At least three must be shared
    (or all, if there are fewer). Each n-gram counts once, and the background's common ones on neither side.

    Of the families a paragraph may have, the likeliest counts. A paragraph is a line; each line of a hard-wrapped licence is a part of a template and counts by itself. Null
    and empty texts, and texts without a licence, have 0, "" and nulls. Rows that share an id, or have none,
    are joined in their result, and repeated rows get equal rows. Whole texts are read, whatever their length; an empty
    table gives an empty result; other columns are ignored, whatever their names.
    """
    spark, n = docs.sparkSession, len(model.families)
    table = cut(model_table(spark, model), "model")  # at most max_features rows, and the common pairs of the sample
    base = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("p", "line"))
    # explode of a one-element array keeps the optimizer from copying the split into lambdas, where it would run once a word
    base = base.select("id", "row", "p", F.explode_outer(F.array(paragraph_words(F.col("line")))).alias("words"))
    base = base.filter(shares_a_pair(F.col("words"), table))
    keys = base.select("id", "row", "p", F.size(F.array_distinct("words")).alias("single"), _keys(F.col("words")).alias("keys"))
    keys = keys.select("id", "row", "p", (F.size("keys") - F.col("single")).alias("pairs"), "keys")  # before the rows are multiplied
    keys = keys.select("id", "row", "p", "pairs", F.explode_outer("keys").alias("h"))
    table = F.broadcast(table)
    templates = template_pairs(model)
    sums = keys.join(table, "h").groupBy("id", "row", "p", "pairs").agg(
        *[F.sum(f"w{i}").alias(f"w{i}") for i in range(n)], F.sum("common").alias("common"),
        *[F.sum(f"t{k}").alias(f"t{k}") for k in range(-(-len(templates) // PACKED))],
    )
    z = F.array(*[F.col(f"w{i}") + float(model.bias[i]) for i in range(n)])
    counts = F.array(*[F.col(f"t{k}") for k in range(-(-len(templates) // PACKED))])
    # one-element arrays again: each step is worked out once a paragraph, not once a use; lambdas over constant arrays keep
    # the generated code small for any number of families and templates
    sums = sums.select("id", "pairs", "common", counts.alias("counts"), F.inline(F.array(F.struct(z.alias("z"), F.array_max(z).alias("top")))))
    sums = sums.select("id", "pairs", "common", "counts", F.explode(F.array(F.transform("z", lambda x: F.exp(x - F.col("top"))))).alias("e"))
    sums = sums.select("*", F.explode(F.array(F.aggregate("e", F.lit(0.0), lambda a, x: a + x))).alias("total"))
    names = F.array(*[F.lit(f) for f in model.families[:-1]])
    known = F.transform(F.slice("e", 1, n - 1), lambda x, i: F.struct((x / F.col("total")).alias("prob"), F.get(names, i).alias("family"), i.alias("i")))
    likely = sums.select("id", "pairs", "common", "counts", F.explode(F.array(F.array_max(known))).alias("k")).filter(F.col("k.prob") >= model.threshold)
    every = json.dumps([{"f": f, "n": len(s), "k": j // PACKED, "s": BITS * (j % PACKED)} for j, (f, s) in enumerate(templates)])
    own = F.filter(F.from_json(F.lit(every), "array<struct<f:int,n:int,k:int,s:int>>"), lambda t: t["f"] == F.col("k.i"))

    def match(t: Column) -> Column:
        least = F.greatest(F.least(F.col("pairs") - F.col("common"), t["n"]), F.lit(1))
        shared = F.call_function("shiftright", F.get("counts", t["k"]), t["s"]).bitwiseAND(F.lit((1 << BITS) - 1))
        return F.when(shared >= F.least(least, F.lit(3)), shared / least).otherwise(F.lit(0.0))

    best = likely.select("id", F.struct("k.prob", "k.family", F.coalesce(F.array_max(F.transform(own, match)), F.lit(0.0)).alias("match")).alias("k")).filter(F.col("k.match") >= confirm)
    per = best.groupBy("id").agg(
        F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("k.family")), ",").alias("families"), F.max("k.prob").alias("best_probability"), F.max("k.match").alias("best_match")
    )
    per = per.withColumnRenamed("id", "id2")
    return docs.select(F.col(id_col).alias("id")).join(per, F.col("id").eqNullSafe(F.col("id2")), "left").select(
        F.col("id").alias(id_col), F.coalesce("n", F.lit(0).cast("bigint")).alias("n_paragraphs"), F.coalesce("families", F.lit("")).alias("families"),
        F.round("best_probability", 6).alias("best_probability"), F.round("best_match", 6).alias("best_match"),
    )


def train(docs: DataFrame, max_docs: int = 400, max_paragraphs: int = 2000, text_col: str = "text", **how) -> LicenseModel:
    """max_docs and max_paragraphs bound what the driver gathers as background."""
    return fit(background_sample(docs, max_docs, max_paragraphs, text_col), **how)
