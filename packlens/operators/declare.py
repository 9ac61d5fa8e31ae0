"""Declarations: candidates of fields, normalised, de-duplicated and united over their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packlens.functions.fuzzy import with_dates
from packlens.functions.patterns import candidates
from packlens.functions.text import normalize_value, not_blank

DATE_FIELDS = ("mfg_date", "best_before_date")
SOURCE_RANK = {"WEBPAGE_TEXT": 0, "STRUCTURED_METADATA": 0, "IMAGE_OCR": 1, "USER_INPUT": 2}


def source_rank(c: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for name, r in SOURCE_RANK.items():
        out = out.when(c == name, F.lit(r))
    return out.otherwise(F.lit(3))


def text_declarations(pages: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """Free-text candidates of every page: keys, ord, field_name, field_value, confidence."""
    return pages.select(*keys, F.inline(candidates(F.col(text_col)))).filter(not_blank(F.col("field_value")))


def normalized(decl: DataFrame, as_of: str | None = None) -> DataFrame:
    """as_of: the day that lends dates their missing parts; with it, dates in other than the listed forms are read too."""
    out = decl.withColumn("normalized_value", normalize_value(F.col("field_name"), F.col("field_value")))
    return out if as_of is None else with_dates(out, "field_value", "normalized_value", as_of, F.col("field_name").isin(*DATE_FIELDS))


def dedup_candidates(decl: DataFrame, source_key: list[str]) -> DataFrame:
    """Per source object and (field, normalised or raw value) the row of highest confidence, the first on ties."""
    key = F.coalesce(F.nullif(F.col("normalized_value"), F.lit("")), F.col("field_value"))
    w = Window.partitionBy(*source_key, "field_name", key).orderBy(F.desc("confidence"), "ord")
    return decl.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def manual_declarations(rows: DataFrame) -> DataFrame:
    """What a user entered: source USER_INPUT at full confidence."""
    return rows.withColumns({"source_type": F.lit("USER_INPUT"), "confidence": F.lit(1.0), "extraction_method": F.lit("MANUAL_ENTRY")})


def best_declaration(decl: DataFrame, key: str = "inspection_id") -> DataFrame:
    """Per (key, field) the declaration of highest confidence; ties by source, then order of extraction."""
    order = F.struct(F.col("confidence"), -source_rank(F.col("source_type")), -F.col("ord"))
    row = F.struct("field_value", "normalized_value", "source_type", "confidence")
    return decl.groupBy(key, "field_name").agg(F.max_by(row, order).alias("best")).select(key, "field_name", "best.*")


def replace_derived(old: DataFrame, new: DataFrame, key: str = "inspection_id") -> DataFrame:
    """A re-run: derived rows of the inspections in new are replaced, user-supplied rows are kept. new is used once, as its
    rows may be dear to derive, and nothing is joined."""
    rows = old.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
    again = F.bool_or("_new").over(Window.partitionBy(key)) & F.col(key).isNotNull()
    return rows.withColumn("_again", again).filter("_new OR NOT _again OR source_type = 'USER_INPUT'").drop("_new", "_again")
