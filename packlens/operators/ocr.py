"""OCR words to declarations: cleaning, reading order per image, and boxes behind each value."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packlens.functions.patterns import candidates


def without_boxes(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """The images (image_id and others) that no box belongs to, which are still to be read; images without an id are among
    them. Rows that repeat stay."""
    return images.join(boxes.select("image_id"), "image_id", "left_anti")


def clean_boxes(boxes: DataFrame, conf_col: str = "conf") -> DataFrame:
    """Blank words go; confidence of 0 to 100 becomes 0 to 1, anything negative or unreadable 0."""
    c = F.coalesce(F.greatest(F.col(conf_col).cast("string").try_cast("double"), F.lit(0.0)), F.lit(0.0)) / 100
    return boxes.filter(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0).withColumn("confidence", c)


def _lines(boxes: list) -> list[list[int]]:
    """Places in boxes by line and in the line: from top to bottom a box joins the first line whose first box is near enough
    in height; lines go by their top, boxes by x."""
    lines: list[list[int]] = []
    y, h, x = ([b[k] for b in boxes] for k in ("y", "height", "x"))
    for i in sorted(range(len(boxes)), key=lambda k: (y[k], boxes[k]["ord"])):
        home = next((ln for ln in lines if abs(y[i] - y[ln[0]]) <= 0.6 * max(h[i], h[ln[0]], 1)), None)
        lines.append([i]) if home is None else home.append(i)
    lines.sort(key=lambda ln: min(y[i] for i in ln))
    return [sorted(ln, key=lambda k: x[k]) for ln in lines]


def reading_order(boxes: DataFrame) -> DataFrame:
    """(image_id, ord, text, confidence, line, pos). The words of an image are one list, and a worker gets many images at a
    time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for image, found in zip(b["image_id"], b["boxes"], strict=True):
                found = list(found)
                rows += [(image, found[i]["ord"], found[i]["text"], found[i]["confidence"], a, p) for a, ln in enumerate(_lines(found)) for p, i in enumerate(ln)]
            yield pd.DataFrame(rows, columns=["image_id", "ord", "text", "confidence", "line", "pos"])

    flat = F.struct("ord", "text", "confidence", F.col("bbox.x").alias("x"), F.col("bbox.y").alias("y"), F.col("bbox.height").alias("height"))
    lists = boxes.groupBy("image_id").agg(F.collect_list(flat).alias("boxes"))
    return lists.mapInPandas(run, "image_id string, ord int, text string, confidence double, line int, pos int")


def image_words(ordered: DataFrame) -> DataFrame:
    """ordered with each word's place in its image's text: piece (the word and what follows it: a blank, and ` \\n` at the end of
    a line), lo and hi. The offsets are one running sum an image."""
    along = Window.partitionBy("image_id").orderBy("line", "pos")
    ends = F.lead("line").over(along) > F.col("line")
    words = ordered.withColumn("piece", F.concat("text", F.when(ends, F.lit(" \n")).otherwise(F.lit(" "))))
    before = F.sum(F.length("piece")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    return words.withColumn("lo", F.coalesce(before, F.lit(0)).cast("int")).withColumn("hi", F.col("lo") + F.length("text"))


def image_text(words: DataFrame) -> DataFrame:
    """(image_id, blob) from image_words: words joined by blanks, lines ended by ` \\n`."""
    pieces = F.array_sort(F.collect_list(F.struct("lo", "piece")))
    return words.groupBy("image_id").agg(F.rtrim(F.array_join(F.transform(pieces, lambda p: p["piece"]), "")).alias("blob"))


#: Characters of a stretch of text: spans meet in the stretches that they touch, never all pairs of an image.
_STRETCH = 64


def ocr_declarations(words: DataFrame) -> DataFrame:
    """Candidates of each image's text (image_id, ord, field_name, field_value, confidence, source_box) with the boxes that the
    value's first occurrence touches: confidence is the pattern's times their mean (0.3 at least), the source is the most
    confident box. A value that stands in no box goes by the image's first."""
    found = image_text(words).select("image_id", "blob", F.inline(candidates(F.col("blob"))))
    at = F.instr("blob", F.col("field_value")) - 1
    found = found.select("image_id", "ord", "field_name", "field_value", "confidence", at.alias("from"), (at + F.length("field_value")).alias("to"))
    stretches = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / _STRETCH), F.floor(F.col(hi) / _STRETCH)))
    spans = found.filter(F.col("from") >= 0).select("image_id", F.col("ord").alias("candidate"), "from", "to", stretches("from", "to").alias("at"))
    boxes = words.select("image_id", F.col("ord").alias("box"), F.col("confidence").alias("c"), "lo", "hi", stretches("lo", "hi").alias("at"))
    touch = (F.col("lo") <= F.col("to")) & (F.col("hi") >= F.col("from"))
    once = F.col("at") == F.floor(F.greatest("lo", "from") / _STRETCH)  # spans that share several stretches meet in one
    met = spans.join(boxes.hint("merge"), ["image_id", "at"]).filter(touch & once)
    best = lambda c, box: F.max_by(box, F.struct(c, -F.col(box)))
    used = met.groupBy("image_id", "candidate").agg(F.avg("c").alias("mean"), best("c", "box").alias("source_box"))
    first = words.filter("lo = 0").groupBy("image_id").agg(F.avg("confidence").alias("first_mean"), F.min("ord").alias("first_box"))
    c = found.join(used.withColumnRenamed("candidate", "ord").hint("merge"), ["image_id", "ord"], "left").join(first.hint("merge"), "image_id", "left")
    mean = F.greatest(F.coalesce("mean", "first_mean"), F.lit(0.3))
    return c.select("image_id", "ord", "field_name", "field_value", (F.floor(F.col("confidence") * mean * 1000 + 0.5) / 1000).alias("confidence"), F.coalesce("source_box", "first_box").alias("source_box"))
