"""Language identification by string kernels.

The blended-spectrum presence kernel of two texts is the number of distinct character n-grams (n = 1 to
`longest`) that both have, normalised by the square root of the product of their own numbers. Nystroem
landmarks turn the kernel into features, and one-versus-rest kernel ridge regression is solved on
them. A text's scores are its presence vector times the landmarks' presence matrix times the
coefficients; the two right factors are multiplied once, so a batch of texts is one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, without

_PRIMES = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)
BLANK = 32


@cache
def _letters() -> np.ndarray:
    """By code point: the code point itself where it is a letter, else a blank."""
    return np.array([c if chr(c).isalpha() else BLANK for c in range(0x110000)], np.uint32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def characters(text: str) -> np.ndarray:
    """Code points of the lower-cased letters; every run of other characters is one blank, and one is at either end."""
    c = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    c = np.concatenate([[BLANK], c, [BLANK]]).astype(np.uint32)
    return c[(c != BLANK) | (np.append(c[1:], 0) != BLANK)]


def presence(text: str, bits: int, longest: int) -> np.ndarray:
    """Indices of the buckets (2**bits) of the character n-grams present in the whole text."""
    c = characters(text)
    flags, acc = np.zeros(1 << bits, bool), np.zeros(len(c), np.uint32)
    for n in range(1, longest + 1):
        if len(c) < n:
            break
        acc = (acc[: len(c) - n + 1] + np.uint32(n)) * np.uint32(_PRIMES[n % 4]) + c[n - 1 :]
        flags[(acc * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)] = True
    return np.flatnonzero(flags)


@dataclass
class LanguageModel:
    langs: list[str]
    weights: np.ndarray  # buckets x languages
    bits: int
    longest: int

    def scores(self, texts: list[str]) -> np.ndarray:
        x = np.zeros((len(texts), 1 << self.bits), np.float32)
        norm = np.ones(len(texts), np.float32)
        for i, t in enumerate(texts):
            at = presence(t, self.bits, self.longest)
            x[i, at] = 1
            norm[i] = max(1, len(at)) ** 0.5
        return (x @ self.weights) / norm[:, None]


def fit(texts: list[str], langs: list[str], landmarks: int = 192, ridge: float = 1e-3, bits: int = 14, longest: int = 3) -> LanguageModel:
    """Fit on a bounded list of labelled texts, on the driver."""
    names = sorted(set(langs))
    if not names:
        return LanguageModel([], np.zeros((1 << bits, 0), np.float32), bits, longest)
    x = np.zeros((len(texts), 1 << bits), np.float32)
    for i, t in enumerate(texts):
        at = presence(t, bits, longest)
        x[i, at] = 1 / max(1, len(at)) ** 0.5
    by = {n: [i for i, y in enumerate(langs) if y == n] for n in names}
    turn = [by[n][k] for k in range(max(map(len, by.values()))) for n in names if k < len(by[n])]  # languages by turns
    marks = x[turn[: max(landmarks, len(names))]]
    val, vec = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = val > 1e-6 * val.max()
    root = vec[:, good] / np.sqrt(val[good])  # K(L,L)^(-1/2) on its range
    phi = (x @ marks.T).astype(np.float64) @ root
    y = np.array([[1.0 if lab == n else -1.0 for n in names] for lab in langs])
    weight = np.array([1 / len(by[lab]) for lab in langs])[:, None]  # every language counts alike
    coef = np.linalg.solve(phi.T @ (phi * weight) + ridge * np.eye(phi.shape[1]), phi.T @ (y * weight))
    return LanguageModel(names, (marks.T @ (root @ coef)).astype(np.float32), bits, longest)


def training_sample(docs: DataFrame, per_lang: int, max_rows: int, max_chars: int, id_col: str, text_col: str, lang_col: str) -> pd.DataFrame:
    """At most per_lang rows of each language and max_rows in all (a language's part is equal for all; of more than
    max_rows languages the most frequent), those with the smallest hashes of their ids among the texts with a
    letter and up to max_chars characters whose crc32(id) mod 3 is not 1.

    Languages are counted first. By the counts a limit for the hash leaves a few times the rows wanted of each,
    so that neither a task nor the driver sees more of a frequent language than of a rare one.
    """
    free = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(
        F.col("lang").isNotNull() & F.col("id").isNotNull() & (F.crc32(F.col("id").cast("string")) % 3 != 1)
        & F.length("text").between(1, max_chars) & F.col("text").rlike(r"\p{L}")
    )
    free = free.withColumn("h", F.xxhash64("id"))
    sizes = free.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_rows)
    sizes = cut(sizes, "languages")
    each = max(1, min(per_lang, max_rows // max(1, sizes.count())))
    share = F.least(F.lit(1.0), F.lit(2.0 * each + 100) / F.col("n"))
    sizes = sizes.select("lang", (F.lit(-(2.0**63)) + share * 2.0**64).alias("most"))
    some = free.join(F.broadcast(sizes), "lang").filter(F.col("h").cast("double") <= F.col("most")).select("id", "lang", "h")  # sizes: max_rows rows at most
    order = Window.partitionBy("lang").orderBy("h", "id")
    some = cut(some.distinct().withColumn("r", F.row_number().over(order)).filter(F.col("r") <= each).select("id", "lang"), "training")
    rows = free.join(F.broadcast(some), ["id", "lang"]).select("id", "lang", "text").dropDuplicates(["id"])
    return rows.toPandas().sort_values("id", kind="stable")


def train(
    docs: DataFrame,
    per_lang: int = 400,
    max_rows: int = 4096,
    max_chars: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    **how,
) -> LanguageModel:
    """per_lang (rows of one language), max_rows (rows of all) and max_chars bound what the driver gathers."""
    got = training_sample(docs, per_lang, max_rows, max_chars, id_col, text_col, lang_col)
    got = got[got["text"].map(has_letter).astype(bool)]
    return fit(got["text"].tolist(), got["lang"].tolist(), **how)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", batch: int = 64) -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score.

    lang_pred is `und` with score 0 where the text is null or has no letter (or nothing was learned).
    score is the best one-versus-rest value, -1 to 1, moved to 0 to 1. Ties go to the first language by
    name. held_out tells crc32(id) mod 3 = 1 (false for a null id). Repeated rows get equal rows; texts of any
    length are read whole; an empty table gives an empty result; other columns are ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            pred, score = np.full(len(b), "und", object), np.zeros(len(b))
            texts = b["text"].tolist()
            at = [i for i, t in enumerate(texts) if m.langs and has_letter(t)]
            for lo in range(0, len(at), batch):
                part = at[lo : lo + batch]
                f = m.scores([texts[i] for i in part])
                best = f.argmax(1)
                pred[part] = np.array(m.langs, object)[best]
                score[part] = np.clip((1 + f[np.arange(len(part)), best].astype(np.float64)) / 2, 0, 1)
            yield pd.DataFrame({"id": b["id"], "held_out": b["held_out"], "lang_pred": pred, "score": score})

    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), F.col(text_col).alias("text")
    )
    return src.mapInPandas(run, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def drop_undetermined(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """docs without those whose language can't be told (no text or no letters); columns unchanged. Rows
    that share an id, and rows without one, go only if none of them has a language."""
    out = predict(docs, train(docs, id_col=id_col, **how), id_col)
    fate = cut(out.groupBy(id_col).agg(F.bool_and(F.col("lang_pred") == "und").alias("bad")).filter("bad").select(id_col), "undetermined")
    return without(docs, fate, [id_col])
