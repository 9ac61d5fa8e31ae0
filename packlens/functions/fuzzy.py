"""Helpers that built-in functions can't express, as pandas UDFs over the few rows that need them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .text import normalize_date, not_blank


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        m = row & at.get(c, 0)
        row = ((row + m) | (row - m)) & full
    return len(a) - row.bit_count()


def ratio(a: str | None, b: str | None) -> float | None:
    """100 * 2 LCS / (len a + len b) over the words in sorted order; null if a side is null."""
    if a is None or b is None:
        return None
    x, y = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    return 100.0 if not x and not y else 200.0 * _lcs(x, y) / (len(x) + len(y))


@F.pandas_udf(DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(a, b, strict=True)], dtype="float64")


def fuzzy_date(as_of: str):
    """A pandas UDF from text to ISO date, day first, missing parts from as_of; for the rows that the
    listed formats did not parse."""

    @F.pandas_udf("string")
    def parse(s: pd.Series) -> pd.Series:
        from dateutil import parser

        base = pd.Timestamp(as_of).to_pydatetime()

        def one(v):
            try:
                return parser.parse(v, fuzzy=True, dayfirst=True, default=base).date().isoformat() if isinstance(v, str) and v.strip() else None
            except (ValueError, OverflowError):
                return None

        return s.map(one).astype(object).where(lambda x: x.notna(), None)

    return parse


def with_dates(df: DataFrame, value: str, out: str, as_of: str, wanted: Column | None = None) -> DataFrame:
    """df with `out` as ISO dates of the text column `value`, in two tiers; of an `out` that df has already, only nulls are
    filled. The listed formats are tried in generated code; only the distinct texts that they leave go to Python
    and come back by a join on the text (split or broadcast by adaptive execution). wanted: which rows hold dates
    (default: all). Null and blank texts and those without a date give null; an empty table stays empty."""
    wanted = F.lit(True) if wanted is None else wanted
    old = F.col(out) if out in df.columns else F.lit(None).cast("string")
    first = df.withColumn(out, F.coalesce(old, F.when(wanted, normalize_date(F.col(value)))))
    left = first.filter(wanted & F.col(out).isNull() & not_blank(F.col(value))).select(F.col(value).alias("_text")).distinct()
    parsed = left.select("_text", fuzzy_date(as_of)(F.col("_text")).alias("_date"))
    joined = first.join(parsed, wanted & F.col(out).isNull() & (F.col(value) == F.col("_text")), "left")
    return joined.withColumn(out, F.coalesce(F.col(out), F.col("_date"))).select(*first.columns)
