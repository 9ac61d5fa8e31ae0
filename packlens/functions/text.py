"""Scalar functions over declaration values, all as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import INSTITUTION_WORDS, TOBACCO_WORDS, VOLUME_UNITS, WEIGHT_UNITS

_DATE_FORMATS = ("yyyy-MM-dd", "d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "d MMM yyyy", "d MMMM yyyy")
_MONTH_FORMATS = ("M/yyyy", "M-yyyy", "MMM yyyy", "MMMM yyyy")
PIN = r"\b\d{6}\b"
LOCALITY = r"[A-Za-z]+\s*,\s*[A-Za-z]+"
WHEN_PACKED = r"(?i)when\s+packed|at\s+the\s+time\s+of\s+packing"


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """body(c), with c worked out once however often body uses it."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def upto(start: Column, end: Column) -> Column:
    """The integers from start to end, without end; none where start reaches it."""
    return F.when(start < end, F.sequence(start, end - 1)).otherwise(F.array().cast("array<int>"))


def running(xs: Column, block: int = 64) -> Column:
    """For each element of an array of integers the sum of those before it. Blocks are summed first, so n elements cost about
    n * block / 2 + (n / block)^2 / 2 additions. Elements are read by place, as a slice would copy the whole array."""
    zero = F.lit(0)
    total = lambda a, start, end: F.aggregate(upto(start, end), zero.cast("bigint"), lambda s, j: s + F.get(a, j))
    div = lambda i: F.floor(i / block).cast("int")

    def sums(x: Column) -> Column:
        n = F.size(x)
        return F.transform(upto(zero, div(n + (block - 1))), lambda b: total(x, b * block, F.least((b + 1) * block, n)))

    starts = lambda x: let(sums(x), lambda t: F.transform(t, lambda _, b: total(t, zero, b)))
    return let(xs, lambda x: let(starts(x), lambda t: F.transform(x, lambda _, i: F.get(t, div(i)) + total(x, div(i) * block, i))))


def strip(c: Column) -> Column:
    """Both ends without any white space."""
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def not_blank(c: Column) -> Column:
    return F.length(strip(F.coalesce(c, F.lit("")))) > 0


def normalize_text(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"[\s\p{Z}]+", " "))


def first_number(c: Column) -> Column:
    """The first number after removing commas, as double; null if there is none."""
    return F.regexp_extract(F.regexp_replace(c, ",", ""), r"\d+(?:\.\d+)?", 0).try_cast("double")


def normalize_currency(c: Column) -> Column:
    """The first number with at most two decimals, written with two; null if there is none."""
    n = F.regexp_extract(F.regexp_replace(c, ",", ""), r"\d+(?:\.\d{1,2})?", 0).try_cast("double")
    return F.when(n.isNotNull(), F.format_string("%.2f", n))


_DIGITS = "०१२३४५६७८९"
_QUANTITY = r"(\d+(?:\.\d+)?)\s*([a-zA-Zऀ-ॿ]+)"


def parse_quantity(c: Column) -> Column:
    """struct<basis, amount> (weight_g or volume_ml) of the first `number unit`; null for unknown units."""
    low = F.translate(F.lower(c), _DIGITS, "0123456789")
    value, unit = F.regexp_extract(low, _QUANTITY, 1).try_cast("double"), F.regexp_extract(low, _QUANTITY, 2)
    known = {**{u: ("weight_g", f) for u, f in WEIGHT_UNITS.items()}, **{u: ("volume_ml", f) for u, f in VOLUME_UNITS.items()}}
    factor = F.create_map(*[x for u, (_, f) in known.items() for x in (F.lit(u), F.lit(float(f)))])
    basis = F.create_map(*[x for u, (b, _) in known.items() for x in (F.lit(u), F.lit(b))])
    found = F.try_element_at(factor, unit)
    return F.when(value.isNotNull() & found.isNotNull(), F.struct(F.try_element_at(basis, unit).alias("basis"), (value * found).alias("amount")))


def plain_number(c: Column) -> Column:
    """A number without trailing zeros (plain digits where a C-style %g would turn to exponents)."""
    return F.regexp_replace(F.format_string("%.6f", c), r"\.?0+$", "")


def normalize_quantity(c: Column) -> Column:
    q = parse_quantity(c)
    return F.when(q.isNotNull(), F.concat(plain_number(q["amount"]), F.when(q["basis"] == "weight_g", F.lit("g")).otherwise(F.lit("ml"))))


def normalize_date(c: Column) -> Column:
    """ISO date by the listed formats, day first; months alone mean their first day. Null otherwise."""
    v = normalize_text(c)
    # a failed parse costs an exception: a format is tried only on texts with its separators
    may = lambda f: F.regexp_count(v, F.lit(r"\Q" + (sep := next(x for x in f if not x.isalpha())) + r"\E")) >= f.count(sep)
    tries = [F.when(may(f), F.try_to_timestamp(v, F.lit(f))) for f in _DATE_FORMATS] + [F.when(may(f), F.try_to_timestamp(F.concat(F.lit("1 "), v), F.lit("d " + f))) for f in _MONTH_FORMATS]
    return F.date_format(F.coalesce(*tries), "yyyy-MM-dd")


def normalize_value(field: Column, value: Column) -> Column:
    return (
        F.when(field.isin("mrp", "unit_sale_price"), normalize_currency(value))
        .when(field == "net_quantity", normalize_quantity(value))
        .when(field.isin("mfg_date", "best_before_date"), normalize_date(value))
        .otherwise(normalize_text(value))
    )


def looks_like_date(c: Column) -> Column:
    """Month/year or a month's name with a year, or one of the listed date formats. Dates in other words are known by
    their normalised value (fuzzy.with_dates)."""
    months = r"(?i)\b\d{1,2}\s*[/.-]\s*\d{2,4}\b|\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[\s.,'-]*\d{2,4}\b"
    return F.coalesce(c.rlike(months) | normalize_date(c).isNotNull(), F.lit(False))


def url_hash(c: Column) -> Column:
    return F.sha2(F.lower(strip(c)), 256)


def page_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    return F.lower(text).rlike("|".join(re.escape(w) for w in words))


def is_tobacco(text: Column) -> Column:
    return has_any(text, TOBACCO_WORDS)


def is_institutional(text: Column) -> Column:
    return has_any(text, INSTITUTION_WORDS)


def number_between(c: Column, low: float, high: float) -> Column:
    return first_number(c).between(low, high)


def display_label(c: Column, known: dict[str, str]) -> Column:
    """The known label, or the code in words with capitals."""
    fallback = F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))
    return F.coalesce(reduce(lambda a, kv: a.when(c == kv[0], F.lit(kv[1])), known.items(), F.when(F.lit(False), F.lit(""))), fallback) if known else fallback
