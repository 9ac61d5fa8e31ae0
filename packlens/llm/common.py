"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import string
import tempfile
import uuid
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Broadcast only what was counted and found to have at most this many narrow rows.
BROADCAST_ROWS = 200_000


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where the session names none, a local temporary folder is
    chosen, once a process; that is right for a local master only, so any other master is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_root()


@cache
def _local_root() -> str:
    return "file://" + tempfile.mkdtemp(prefix="packlens-")


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and a lost
    executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/packlens-{uuid.uuid4().hex}/{label}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII values take the fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a side whose row count has been taken; plain (shuffled) beyond the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def helper(df: DataFrame, name: str) -> str:
    """name, with underscores before it as long as df has such a column (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def without(docs: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    """The rows of docs whose values in the columns `on` are in no row of gone (same columns); nulls match nulls.
    gone's columns get names that docs has not."""
    names = [helper(docs, f"gone_{i}") for i in range(len(on))]
    gone = gone.toDF(*names)
    same = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(n)) for c, n in zip(on, names, strict=True)])
    return docs.join(maybe_broadcast(gone, gone.count()), same, "left_anti")
