"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of its documents, in the order in which they are read. In each window (a round) a
queue is given its quantum, the target proportion of the window's tokens, on top of the deficit that it
carries from the windows before; it is served whole documents while the next one fits into that sum, and
what is left is the deficit that it carries on. A queue that runs dry leaves its share to the others.

A document that ends at token C of its queue is therefore served in the first window r with r * quantum
>= C: the deficit of a queue after window r is r * quantum less the tokens that it was served. So the schedule
needs no loop. Token counts per task and source give the ends C, whatever partition a document lies in;
sums per window and source give the places of windows in the packed stream. The stream is cut into
sequences; only the last one is short.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, maybe_broadcast

SEQ_LEN = 1024
#: Latin text without odd white space or control characters: here both libraries split alike.
_PLAIN = re.compile(r"[^\t\n\r -~¡-¬®-ɏ]")
#: Windows that are summed up together where the windows' places in the stream are counted.
STRIDE = 1024
#: Bytes of an id in a document's ids.
_ID = 4


@cache
def encoder(json_file: str, ranks_file: str | None):
    """A function from text to ids (little-endian, 32 bits each). ranks_file: the same vocabulary for a faster library,
    used on plain Latin texts only, where the ids are the same."""
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_file)
    fast = None
    if ranks_file:
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if fast is not None and not _PLAIN.search(text) and "<|" not in text:
            ids = fast.encode_ordinary(text)
        else:
            ids = slow.encode(text, add_special_tokens=False).ids
        return np.array([*ids, 0], "<u4")

    return encode


def tokenized(docs: DataFrame, json_file: str, ranks_file: str | None, id_col: str, text_col: str, queue_col: str) -> DataFrame:
    """(id, queue, part, at, n, ids): at is where the document's tokens begin among those of its queue in the task."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, part, at = encoder(json_file, ranks_file), TaskContext.get().partitionId(), {}
        for b in batches:
            for lo in range(0, len(b), 512):
                c = b.iloc[lo : lo + 512]
                ids = [encode(t or "") for t in c["text"]]
                begin = []
                for q, x in zip(c["queue"], ids, strict=True):
                    begin.append(at.get(q, 0))
                    at[q] = begin[-1] + len(x)
                yield pd.DataFrame(
                    {"id": c["id"], "queue": c["queue"], "part": part, "at": begin, "n": [len(x) for x in ids], "ids": [x.tobytes() for x in ids]}
                )

    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(queue_col).cast("string"), F.lit("")).alias("queue"), F.col(text_col).alias("text"))
    return src.mapInPandas(run, f"id {kind}, queue string, part int, at bigint, n bigint, ids binary")


def quanta(totals: DataFrame, window: int, weights: DataFrame | None = None, temper: float = 1.0) -> DataFrame:
    """(queue, quantum): tokens that a window gives to each queue of totals (queue, total).

    Target proportions are weights (queue, weight), or the totals to the power `temper`: 1 keeps the supply's
    proportions, less favours small sources. A queue without a positive weight is served after a
    window's length of documents for every window, as if it had a millionth of the least weight.
    """
    if weights is None:
        w = totals.select("queue", F.pow(F.col("total").cast("double"), F.lit(float(temper))).alias("w"))
    else:
        given = weights.groupBy("queue").agg(F.sum("weight").alias("w")).filter("w > 0")
        least = F.coalesce(F.min("w"), F.lit(1.0)) * 1e-6
        w = totals.select("queue").join(given, "queue", "left").crossJoin(F.broadcast(given.agg(least.alias("least"))))
        w = w.select("queue", F.coalesce("w", "least").alias("w"))
    whole = w.agg(F.sum("w").alias("all"))
    return w.crossJoin(F.broadcast(whole)).select("queue", (F.col("w") / F.col("all") * window).alias("quantum"))


def schedule(placed: DataFrame) -> DataFrame:
    """(queue, window, first, place): for each window and queue the end-less place in the queue of its first document
    and the place of that document in the stream, from placed (queue, window, begin, n).

    Windows follow each other and, in a window, queues by name. Sums of STRIDE windows come first, so that no
    task sorts more than those sums or the queues of STRIDE windows.
    """
    sums = cut(placed.groupBy("window", "queue").agg(F.sum("n").alias("n"), F.min("begin").alias("first")), "windows")
    sums = sums.withColumn("group", F.floor(F.col("window") / STRIDE))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    groups = sums.groupBy("group").agg(F.sum("n").alias("n"))
    groups = groups.select("group", F.coalesce(F.sum("n").over(before(F.lit(0)).orderBy("group")), F.lit(0)).alias("earlier"))
    inner = F.coalesce(F.sum("n").over(before("group").orderBy("window", "queue")), F.lit(0))
    return sums.withColumn("inner", inner).join(groups, "group").select("queue", "window", "first", (F.col("earlier") + F.col("inner")).alias("place"))


def pack(
    docs: DataFrame,
    json_file: str,
    ranks_file: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    queue_col: str = "source",
    weights: dict[str, float] | DataFrame | None = None,
    temper: float = 1.0,
    seq_len: int = SEQ_LEN,
    window_sequences: int = 16,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue, window.

    A document is its ids and one id 0, served whole and cut only where a sequence ends; window is the round in
    which it was served. Target proportions: weights by source (a dict, or a frame of queue and weight), else the
    totals to the power `temper`. In the windows 1 to r a queue that is not dry has had at most r quanta, and less
    than those by less than its next document.

    Null texts are empty (one id); rows with null or repeated ids are documents of their own; null sources are
    one queue. Texts of any length are read whole; a document longer than a quantum waits until its deficit
    suffices. Other columns are ignored, whatever their names. An empty table gives an empty result. Every source
    is a queue of its own at any number of sources; the driver gathers nothing.
    """
    spark = docs.sparkSession
    if isinstance(weights, dict):
        weights = spark.createDataFrame([(str(q), float(w)) for q, w in weights.items()], "queue string, weight double")
    toks = cut(tokenized(docs, json_file, ranks_file, id_col, text_col, queue_col), "tokens")
    sums = cut(toks.groupBy("queue", "part").agg(F.sum("n").alias("n")), "sums")
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    quantum = quanta(sums.groupBy("queue").agg(F.sum("n").alias("total")), seq_len * window_sequences, weights, temper)
    base = cut(base.join(quantum, "queue"), "base")
    placed = toks.join(maybe_broadcast(base, base.count()), ["queue", "part"]).withColumn("begin", F.col("base") + F.col("at"))
    placed = placed.withColumn("window", F.ceil((F.col("begin") + F.col("n")) / F.col("quantum")))
    starts = cut(schedule(placed.select("queue", "window", "begin", "n")), "starts")
    placed = placed.join(maybe_broadcast(starts, starts.count()), ["queue", "window"])
    place = F.col("place") + F.col("begin") - F.col("first")
    placed = placed.select("id", "queue", "window", place.alias("place"), "n", "ids")

    def piece(sequence: Column) -> Column:
        """What of a document lies in a sequence."""
        start = F.greatest(sequence * seq_len - F.col("place"), F.lit(0))
        length = F.least(F.col("n"), (sequence + 1) * seq_len - F.col("place")) - start
        ids = F.substring("ids", (start * _ID + 1).cast("int"), (length * _ID).cast("int"))
        at = F.when(start == 0, F.col("place") % seq_len).otherwise(F.lit(0))
        return F.struct(start.alias("start"), length.alias("length"), F.crc32(ids).alias("ids_crc32"), F.col("n").alias("doc_tokens"), sequence.alias("sequence_id"), at.alias("offset"))

    over = F.sequence(F.floor(F.col("place") / seq_len), F.floor((F.col("place") + F.col("n") - 1) / seq_len))
    pieces = placed.select("id", "queue", "window", F.transform(over, piece).alias("piece"))
    return pieces.select("id", F.inline("piece"), "queue", "window").withColumnRenamed("id", id_col)
