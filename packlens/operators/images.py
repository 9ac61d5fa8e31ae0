"""Image quality: three numbers per image in the scan stage, thresholds as expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grey_stats(data: bytes, height: int, width: int, channels: int) -> tuple[float, float, float]:
    """Variance of the 3x3 edge filter, standard deviation, and share of pixels of 250 or more."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)
    g = a[:, :, 0] if channels == 1 else a[:, :, :3] @ np.array([0.114, 0.587, 0.299])  # stored as blue, green, red
    p = np.pad(g, 1, mode="edge")
    edges = -sum(p[i : i + height, j : j + width] for i in range(3) for j in range(3)) + 9 * g
    return float(np.clip(edges, 0, 255).var()), float(g.std()), float((g >= 250).mean())


def quality(images: DataFrame) -> DataFrame:
    """origin, width, height, blur_score, contrast_score, glare_share, is_blurry, glare_detected, quality_acceptable,
    quality_notes for rows of Spark's image source."""

    @F.pandas_udf("blur double, contrast double, glare double")
    def stats(img: pd.DataFrame) -> pd.DataFrame:
        rows = [grey_stats(d, h, w, n) for d, h, w, n in zip(img["data"], img["height"], img["width"], img["nChannels"], strict=True)]
        return pd.DataFrame(rows, columns=["blur", "contrast", "glare"])

    s = images.select("image.origin", "image.width", "image.height", stats("image").alias("s"))
    s = s.select("origin", "width", "height", F.col("s.blur").alias("blur_score"), F.col("s.contrast").alias("contrast_score"), F.col("s.glare").alias("glare_share"))
    blurry, flat = F.col("blur_score") < 800, F.col("contrast_score") < 25
    glare = (F.col("glare_share") > 0.5) & ~flat
    notes = F.concat_ws("; ", F.when(blurry, "blurry"), F.when(flat, "low contrast"), F.when(glare, "glare"), F.when(F.least("width", "height") < 400, "low resolution"))
    return s.withColumns({"is_blurry": blurry, "glare_detected": glare, "quality_acceptable": ~blurry & ~flat & ~glare, "quality_notes": notes})
