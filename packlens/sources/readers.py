"""Sources and sinks: page captures, OCR boxes, images, URL lists, JDBC tables, and the result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOX = "image_id string, ord int, text string, confidence double, bbox struct<x:int,y:int,width:int,height:int>, engine string"
CAPTURE = (
    "page_id string, inspection_id string, url string, platform string, fetch_status string, http_status_code int, robots_txt_allowed boolean, "
    "html string, fetched_at timestamp"
)


def page_captures(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CAPTURE).parquet(path)


def saved_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored HTML files, one row each."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("html"))


def ocr_boxes(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    return spark.read.format(kind).schema(BOX).load(path)


def images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded pixels (PNG, JPEG, BMP); what can't be decoded is left out."""
    return spark.read.format("image").option("dropInvalid", True).load(path)


def image_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """A text file of URLs as (batch_id, pos, url): the file is the batch, the line the position."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("batch_id"), F.split(F.regexp_replace("value", r"\s+$", ""), r"\r?\n").alias("urls"))
    return text.select("batch_id", F.posexplode("urls").alias("pos", "url"))


def jdbc_bounds(spark: SparkSession, url: str, name: str, key: str, **options: str) -> tuple[int, int, int]:
    """(least key, greatest key, rows) of a table, asked of the database; keys are 0 where there is none.
    Names are written as the database wants them, quoted if need be."""
    ask = f"SELECT MIN({key}) AS lo, MAX({key}) AS hi, COUNT(*) AS n FROM {name}"
    r = spark.read.format("jdbc").options(url=url, query=ask, **options).load().first()
    lo, hi, n = (int(v) if v is not None else 0 for v in r)
    return lo, hi, n


def jdbc_table(spark: SparkSession, url: str, name: str, key: str, rows: int = 1_000_000, most: int = 256, **options: str) -> DataFrame:
    """A database table read in parts by ranges of an integer key, which a first query bounds; about `rows` rows a part where keys
    are spread evenly, and at most `most` parts, as each is a connection. Rows with a null key come with the first part,
    keys beyond the bounds (rows added since) with the outer ones; an empty table gives no rows."""
    lo, hi, n = jdbc_bounds(spark, url, name, key, **options)
    parts = min(most, max(1, -(-n // rows)), hi - lo + 1)
    where = {"partitionColumn": key, "lowerBound": str(lo), "upperBound": str(hi + 1), "numPartitions": str(parts)} if parts > 1 else {}
    return spark.read.format("jdbc").options(url=url, dbtable=name, **where, **options).load()


def write_results(run_date: str, folder: str, **tables: DataFrame) -> None:
    """Each result table as Parquet under its name, one partition per run date, which a re-run replaces."""
    for name, df in tables.items():
        out = df.withColumn("run_date", F.lit(run_date).cast("date")).write.mode("overwrite")
        out.option("partitionOverwriteMode", "dynamic").partitionBy("run_date").parquet(f"{folder}/{name}")


def write_reports(snapshots: DataFrame, folder: str) -> None:
    snapshots.write.mode("overwrite").json(folder)
