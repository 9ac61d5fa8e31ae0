"""Incremental audit: captures that arrive in a folder, applied to stored results batch by batch.

A micro-batch goes through the same functions as a batch job: of its captures the newest of each page that is newer than the
stored one goes on; what a page declares replaces what it declared before, except for what a user entered (S9); its rules
are evaluated again; its product takes the new values that aren't empty (J10). The ledger applies each batch once.
A batch may be as large as the table: its rows are merged, never broadcast.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from packlens.functions.text import url_hash
from packlens.operators import declare, products
from packlens.streaming.ledger import Ledger, Table


def latest_captures(captures: DataFrame, key: str = "url", at: str = "fetched_at") -> DataFrame:
    """Of the captures of one page the last one; ties go to the larger row. Combined before the shuffle, so that a page
    that is captured a million times is one row a task."""
    row = F.struct(F.col(at), *[c for c in captures.columns if c != at])
    best = captures.groupBy(F.col(key).alias("_key")).agg(F.max(row).alias("_row"))
    return best.select(*[F.col(f"_row.{c}") for c in captures.columns])


def scan_folder(
    spark: SparkSession, source: str, schema: StructType | str, job: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, max_files: int = 1000
) -> StreamingQuery:
    """Read what is new in source, run job on each micro-batch and write it under target, one partition per
    batch id, so that a batch that is run again replaces itself. Ends when nothing new is left."""

    def write(batch: DataFrame, batch_id: int) -> None:
        out = job(batch).withColumn("batch_no", F.lit(batch_id))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_no").parquet(target)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@dataclass
class Scan:
    """A stored audit that captures update.

    captures: their schema, with key, url and fetched_at. derive gives a page's declarations (key, field_name, field_value,
    normalized_value, confidence, ord, source_type) from captures; judge gives checks from captures and all
    declarations of theirs; product gives (url, title, brand, description, listed_price, currency, fetched_at), or null
    where no products are kept.
    """

    spark: SparkSession
    folder: str
    captures: StructType
    derive: Callable[[DataFrame], DataFrame]
    judge: Callable[[DataFrame, DataFrame], DataFrame]
    product: Callable[[DataFrame], DataFrame] | None = None
    key: str = "inspection_id"

    DECLARATIONS = "field_name string, field_value string, normalized_value string, confidence double, ord int, source_type string"
    CHECKS = "rule_key string, severity string, title string, handler string, checked_fields array<string>, source_document string, status string, confidence double, reason string"
    PRODUCTS = "url_hash string, canonical_url string, title string, brand string, description string, listed_price decimal(12,2), currency string, last_checked_at timestamp"

    def __post_init__(self) -> None:
        of = lambda ddl: StructType.fromDDL(f"{self.key} string, {ddl}")
        self.ledger = Ledger(self.spark, self.folder, {
            "captures": Table(self.captures, self.key), "declarations": Table(of(self.DECLARATIONS), self.key), "checks": Table(of(self.CHECKS), self.key),
            "products": Table(StructType.fromDDL(self.PRODUCTS), "url_hash"),
        })

    def current(self, name: str) -> DataFrame:
        return self.ledger.current(name)

    def start(self, source: str, checkpoint: str, max_files: int = 1000) -> StreamingQuery:
        """Apply what is new in source and end. The query's id, which its checkpoint keeps, and the batch id name a batch."""
        stream = self.spark.readStream.schema(self.captures).option("maxFilesPerTrigger", max_files).parquet(source)
        name = self._name(checkpoint)
        return stream.writeStream.foreachBatch(lambda b, i: self.apply(b, name, i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    @staticmethod
    def _name(checkpoint: str) -> str:
        """A query goes by its checkpoint: started again there, it numbers its batches on."""
        import hashlib

        return hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]

    def apply(self, batch: DataFrame, query: str, number: int) -> None:
        """One batch of captures. Nothing happens if it has been applied."""
        seq = self.ledger.begin(query, number)
        if seq is None:
            return
        self.ledger.put("captures", seq, self._fresh(batch))
        fresh = self.spark.read.schema(self.captures).parquet(f"{self.ledger.folder}/captures/seq={seq}")
        keys = fresh.select(self.key)
        old = self.ledger.current("declarations", keys)
        new = self.derive(fresh).select(*old.columns)
        self._rejudge(seq, fresh, declare.replace_derived(old, new, self.key).join(keys.hint("merge"), self.key, "left_semi"))
        rows = self.spark.createDataFrame([], StructType.fromDDL(self.PRODUCTS))
        if self.product is not None:
            seen = self.product(fresh)
            stored = self.ledger.current("products", seen.select(url_hash(F.col("url")).alias("url_hash")))
            rows = products.upsert(stored, seen)
        self.ledger.put("products", seq, rows)
        self.ledger.done(query, number, seq)

    def enter(self, rows: DataFrame, query: str, number: int) -> None:
        """What users entered (key, field_name, field_value) for stored captures; it stays when their pages are captured
        again. A field entered again takes the new value."""
        seq = self.ledger.begin(query, number)
        if seq is None:
            return
        keys = rows.select(self.key).distinct()
        entered = declare.normalized(declare.manual_declarations(rows.withColumn("ord", F.lit(0)))).drop("extraction_method")
        old = self.ledger.current("declarations", keys)
        again = entered.select(self.key, "field_name", "source_type")
        kept = old.join(again.hint("merge"), [self.key, "field_name", "source_type"], "left_anti")
        captures = self.ledger.current("captures", keys)
        self.ledger.put("captures", seq, captures)
        self._rejudge(seq, captures, kept.unionByName(entered.select(*old.columns)))
        self.ledger.put("products", seq, self.spark.createDataFrame([], StructType.fromDDL(self.PRODUCTS)))
        self.ledger.done(query, number, seq)

    def _fresh(self, batch: DataFrame) -> DataFrame:
        """The newest capture of each page of the batch, if it is newer than the stored one."""
        last = latest_captures(batch.select(*self.captures.fieldNames()), self.key)
        stored = self.ledger.current("captures", batch.select(self.key)).select(F.col(self.key).alias("_stored"), F.col("fetched_at").alias("_at"))
        return last.join(stored.hint("merge"), (F.col(self.key) == F.col("_stored")) & (F.col("_at") >= F.col("fetched_at")), "left_anti")

    def _rejudge(self, seq: int, captures: DataFrame, declarations: DataFrame) -> None:
        self.ledger.put("declarations", seq, declarations)
        own = self.ledger.tables["declarations"].schema
        written = self.spark.read.schema(own).parquet(f"{self.ledger.folder}/declarations/seq={seq}")
        self.ledger.put("checks", seq, self.judge(captures, written))
