"""Secret scan by a trigram inverted index, in DataFrame functions only.

1. Each rule's regular expression gives a Boolean query over mandatory trigrams.
2. Postings (trigram, document key) are made for the trigrams that occur in any query.
3. Per document the postings are intersected and united as the queries say, which leaves candidates.
4. Candidates are verified with the expression itself. Rules without mandatory trigrams (the
   hexadecimal one) are verified on every document.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, maybe_broadcast
from .trigram import ANY, trigram_query, trigrams


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # one that Java and Python read alike
    group: int = 0  # the group whose length counts
    least: int = 1  # fewer characters than this: no finding
    base: bool = False


#: The base kinds in the order of the contract, then what this method adds.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]+", 0, 32, True),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36}", 0, 40),
    Rule("chat", r"xox[abpr]-[A-Za-z0-9-]{10,}", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 20),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
)


def _holds(query: tuple, has: dict[str, Column]) -> Column:
    if query[0] == "tri":
        return has[query[1]]
    parts = [_holds(q, has) for q in query[1:]]
    return reduce(lambda a, b: a & b, parts) if query[0] == "and" else reduce(lambda a, b: a | b, parts)


def postings(docs: DataFrame, wanted: list[str], key: Column, text_col: str = "text") -> DataFrame:
    """(trigram, key) for every document and every wanted trigram in its lower-cased text."""
    low = docs.select(key.alias("key"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("low"))
    return low.select(
        "key", F.explode(F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in wanted]))).alias("trigram")
    )


def candidates(docs: DataFrame, rules: tuple[Rule, ...], key: Column, text_col: str = "text") -> DataFrame:
    """key and one flag c_<kind> for each rule with mandatory trigrams; keys without any flag are left out."""
    asked = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) != ANY}
    wanted = list(dict.fromkeys(t for q in asked.values() for t in trigrams(q)))
    met = postings(docs, wanted, key, text_col).groupBy("key").agg(*[F.bool_or(F.col("trigram") == t).alias(f"t{i}") for i, t in enumerate(wanted)])
    has = {t: F.col(f"t{i}") for i, t in enumerate(wanted)}
    flags = met.select("key", *[_holds(q, has).alias(f"c_{k}") for k, q in asked.items()])
    return flags.filter(reduce(lambda a, b: a | b, [F.col(f"c_{k}") for k in asked]))


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Findings of one rule as array<struct<start,rank,span>>, in code points. Texts between matches
    (split) and matches (extract) alternate, so a running sum of their lengths gives the offsets."""
    p = F.lit(rule.pattern)
    every = F.regexp_extract_all(text, p, F.lit(0))
    part = every if rule.group == 0 else F.regexp_extract_all(text, p, F.lit(rule.group))
    between = F.split(text, rule.pattern, -1)
    one = "struct<start:bigint,rank:int,span:string>"

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["between"])
        end = start + F.char_length(x["all"])
        hit = F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), F.concat_ws(":", F.lit(rule.kind), start.cast("string"), end.cast("string")).alias("span")
        )
        good = F.char_length(x["part"]) >= rule.least
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["out"], F.array(hit))).otherwise(acc["out"]).alias("out"))

    zipped = F.arrays_zip(F.slice(between, F.lit(1), F.size(every)).alias("between"), every.alias("all"), part.alias("part"))
    init = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{one}>").alias("out"))
    return F.aggregate(zipped, init, step, lambda acc: acc["out"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: id, n_<kind> for base kinds, base_sha256, spans, n_added.

    Matches of a kind are leftmost and non-overlapping; those that are too short are dropped after
    matching. spans is all findings as kind:start:end (code points, end exclusive), by start and then
    by the order of the rules. A null text is empty and has no findings (the digest is that of the
    empty string). Rows that share an id share candidates only; each is verified on its own text. Texts of any
    length are read whole; an empty table gives an empty result; other columns are ignored, whatever their names.
    """
    key = F.xxhash64(F.col(id_col))  # also defined for null ids; a clash only adds a candidate
    found = cut(candidates(docs, rules, key, text_col), "candidates")
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"), key.alias("key"))
    rows = rows.join(maybe_broadcast(found, found.count()), "key", "left")
    none = F.array().cast("array<struct<start:bigint,rank:int,span:string>>")
    cols = []
    for rank, r in enumerate(rules):
        scan = f"[0-9a-f]{{{r.least}}}" if r.kind == "hex" else r.pattern
        ask = F.col("__text").rlike(scan)
        if f"c_{r.kind}" in found.columns:
            ask = F.coalesce(F.col(f"c_{r.kind}"), F.lit(False)) & ask
        cols.append(F.when(ask, _spans(F.col("__text"), r, rank)).otherwise(none).alias(f"s_{r.kind}"))
    spans = rows.select("__id", *cols)
    base = [r.kind for r in rules if r.base]
    joined = lambda kinds: F.array_join(F.transform(F.array_sort(F.concat(*[F.col(f"s_{k}") for k in kinds])), lambda x: x["span"]), ",")
    return spans.select(
        F.col("__id").alias(id_col),
        *[F.size(f"s_{k}").cast("bigint").alias(f"n_{k}") for k in base],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined([r.kind for r in rules]).alias("spans"),
        sum((F.size(f"s_{r.kind}") for r in rules if not r.base), F.lit(0)).cast("bigint").alias("n_added"),
    )
