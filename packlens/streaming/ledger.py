"""Tables that a stream keeps up to date, with each micro-batch applied exactly once.

A table is a log of Parquet partitions, one for each applied batch (`seq`). A batch writes, for every key it touches, all
rows that the key has from then on; the current rows of a key are those of its last seq. The ledger holds which batch
of which query has which seq, and whether it is done. A batch is begun (its seq is settled), its partitions
are written, and it is marked done. Readers see batches that are done and nothing else. A batch that ends half way is run
again under its old seq and overwrites what it left; one that was done is left alone. `compact` rewrites the current
rows as one new base, so that readers needn't look at what is older.

Everything lies in one shared folder. One writer at a time is assumed, as with any file sink.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_LEDGER = "query string, batch bigint, seq bigint, state string"
#: Keys are broadcast only when counted and found to be at most so many; more of them are merged with the log.
FEW_KEYS = 200_000


@dataclass(frozen=True)
class Table:
    schema: StructType
    key: str  # the column whose rows are replaced together


class Ledger:
    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, Table]):
        self.spark, self.folder, self.tables = spark, folder.rstrip("/"), tables

    def _entries(self) -> list:
        """One entry a batch: a few bytes each, and only those since the last base count."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/ledger")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return []
        return self.spark.read.schema(_LEDGER).json(f"{self.folder}/ledger/*").collect()

    def _note(self, query: str, batch: int, seq: int, state: str) -> None:
        one = self.spark.createDataFrame([(query, batch, seq, state)], _LEDGER)
        one.coalesce(1).write.mode("overwrite").json(f"{self.folder}/ledger/{query}-{batch}-{state}")

    def begin(self, query: str, batch: int) -> int | None:
        """The seq of a batch; null if it is done already."""
        found = self._entries()
        own = [e for e in found if (e["query"], e["batch"]) == (query, batch)]
        if any(e["state"] != "begun" for e in own):
            return None
        if own:
            return own[0]["seq"]
        seq = max((e["seq"] for e in found), default=0) + 1
        self._note(query, batch, seq, "begun")
        return seq

    def put(self, name: str, seq: int, rows: DataFrame) -> None:
        t = self.tables[name]
        rows.select(*[F.col(f.name).cast(f.dataType) for f in t.schema]).write.mode("overwrite").parquet(f"{self.folder}/{name}/seq={seq}")

    def done(self, query: str, batch: int, seq: int, state: str = "done") -> None:
        self._note(query, batch, seq, state)

    def _visible(self) -> list[int]:
        found = self._entries()
        base = max((e["seq"] for e in found if e["state"] == "base"), default=0)
        return sorted(e["seq"] for e in found if e["state"] in ("done", "base") and e["seq"] >= base)

    def current(self, name: str, keys: DataFrame | None = None) -> DataFrame:
        """The current rows of a table; keys (one column, the table's key): only of these. The log is reduced to each
        key's last seq before anything is joined. Spark would take a side of compressed files for small and build
        it in the driver, so every other join is a merge."""
        t, seqs = self.tables[name], self._visible()
        if not seqs:
            return self.spark.createDataFrame([], t.schema)
        paths = [f"{self.folder}/{name}/seq={s}" for s in seqs]
        log = self.spark.read.schema(t.schema).option("basePath", f"{self.folder}/{name}").parquet(*paths)
        log = log.withColumn("seq", F.regexp_extract(F.col("_metadata.file_path"), r"/seq=(\d+)/", 1).cast("bigint"))
        if keys is not None:
            few = keys.count() <= FEW_KEYS
            log = log.join(F.broadcast(keys.distinct()) if few else keys.distinct().hint("merge"), t.key, "left_semi")
        last = log.groupBy(F.col(t.key).alias("_key")).agg(F.max("seq").alias("_seq"))
        same = F.col(t.key).eqNullSafe(F.col("_key")) & (F.col("seq") == F.col("_seq"))
        return log.join(last.hint("merge"), same, "left_semi").select(*t.schema.fieldNames())

    def compact(self, label: str = "compaction") -> None:
        """A new base that holds all current rows."""
        number = len(self._entries())
        seq = self.begin(label, number)
        for name in self.tables:
            self.put(name, seq, self.current(name))
        self.done(label, number, seq, "base")
