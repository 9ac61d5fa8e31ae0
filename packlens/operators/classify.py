"""Product category by keyword votes."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from packlens.functions.vocab import CATEGORY_WORDS


#: What may stand between two words of a text.
_BREAKS = r"[^\p{L}\p{N}_]+"
_SINGLE = tuple(dict.fromkeys(w for ws in CATEGORY_WORDS.values() for w in ws if " " not in w))
_PHRASES = tuple(dict.fromkeys(w for ws in CATEGORY_WORDS.values() for w in ws if " " in w))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once a row however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _texts(words: tuple[str, ...]) -> Column:
    return F.from_json(F.lit(json.dumps(words)), "array<string>")


def keywords(text: Column) -> Column:
    """The keywords that occur as words. The text is cut into words once and those are looked up in the vocabulary by hash;
    a phrase is looked for as a word only where its letters occur."""
    low = F.lower(F.coalesce(text, F.lit("")))
    phrases = [F.when(low.contains(p), F.when(low.rlike(rf"(?U)\b{p}\b"), F.lit(p))) for p in _PHRASES]
    return F.concat(F.array_intersect(F.split(low, _BREAKS), _texts(_SINGLE)), F.array_compact(F.array(*phrases)))


def votes(found: Column) -> dict[str, Column]:
    """Per category its words among those found, in vocabulary order; a word listed twice counts twice."""
    return {cat: F.filter(_texts(words), lambda w: F.array_contains(found, w)) for cat, words in CATEGORY_WORDS.items()}


def _decided(v: Column) -> Column:
    """The outcome of at least one vote."""
    n = {c: F.size(v[c]) for c in CATEGORY_WORDS}
    total, top = reduce(lambda a, b: a + b, n.values()), F.greatest(*n.values())
    pick = F.coalesce(*[F.when(n[c] == top, F.lit(c)) for c in n])
    words = F.coalesce(*[F.when(n[c] == top, v[c]) for c in n])
    conf = F.round(F.greatest(F.least(0.55 + 0.1 * top, F.lit(0.9)) * top / total, F.lit(0.35)), 2)
    return F.struct(pick.alias("category"), conf.alias("confidence"), words.alias("matched"))


def classify(text: Column) -> Column:
    """struct<category, confidence, matched>: most votes win, earlier categories on ties."""
    none = F.array().cast("array<string>")
    unknown = lambda c: F.struct(F.lit("UNKNOWN").alias("category"), F.lit(c).alias("confidence"), none.alias("matched"))
    empty = F.length(F.trim(F.coalesce(text, F.lit("")))) == 0

    def counted(found: Column) -> Column:
        every = F.struct(*[a.alias(c) for c, a in votes(found).items()])
        return F.when(F.size(found) == 0, unknown(0.1)).otherwise(_bound(every, _decided))

    return F.when(empty, unknown(0.0)).otherwise(_bound(keywords(text), counted))


def final_category(overridden: Column, manual: Column, predicted: Column) -> Column:
    """A category set by hand wins over the classifier's."""
    return F.coalesce(F.when(overridden, manual), predicted)
