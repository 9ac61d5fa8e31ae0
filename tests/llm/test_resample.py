import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from packlens.llm import resample as R
from packlens.llm.ranked import part_counts, sorted_parts

from .conftest import make

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def feats(text, longest):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return w, [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, longest=1, buckets=10_000, percent=10, least=20):
    at = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(at(f) for x in texts for f in feats(x, longest)[1]) for texts in ([x for _, x in docs], target))
    a, b = float(sum(s.values()) + buckets), float(sum(t.values()) + buckets)
    gain = [math.floor(1000 * math.log((t[i] + 1.0) * a / ((s[i] + 1.0) * b))) for i in range(buckets)]
    out = []
    for i, x in docs:
        w, f = feats(x, longest)
        u = (int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296
        weight = sum(gain[at(g)] for g in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log(u))), None, len(w)])
    pool = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for n, r in enumerate(pool[: len(pool) * percent // 100], 1):
        r[4] = n
    return sorted((tuple(r[:5]) for r in out), key=str)


def run(df, target, **kw):
    return sorted(map(tuple, R.resample(df, target, **kw).collect()), key=str)


def test_equal_to_brute_force(spark, docs, bench):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    target = [r.text for r in bench.collect()]
    assert run(docs, bench) == brute(rows, target)
    assert run(docs, bench, longest=2, buckets=997, percent=37) == brute(rows, target, 2, 997, 37)


def test_odd_rows(spark, odd_docs, bench, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    df = odd_docs.withColumn("weight", F.lit(1)).withColumn("rank", F.lit(1))
    assert run(df, bench, least_words=0, percent=60) == brute(rows, [r.text for r in bench.collect()], percent=60, least=0)
    assert run(df, bench.limit(0), percent=100) == brute(rows, [], percent=100)
    assert run(no_docs, bench) == []


def test_documents_like_the_target_are_drawn(spark):
    """The target's words are a rare tenth of the corpus."""
    rare = [" ".join(f"rare{(i * 7 + j) % 50}" for j in range(40)) for i in range(30)]
    rest = [" ".join(f"word{(i * 13 + j) % 400}" for j in range(40)) for i in range(270)]
    out = R.resample(make(spark, rare + rest), make(spark, rare[:5]), percent=10).filter("rank is not null").collect()
    assert len(out) == 30 and sum(r.doc_id < 30 for r in out) >= 29


@pytest.mark.parametrize("values", ["spread", "one", "two"])
@pytest.mark.parametrize("accuracy", [2, 10_000])
def test_cutoff_from_a_coarse_sketch(spark, values, accuracy):
    """However coarse the sketch is, exact counts settle the cutoff; a score that most rows share is cut by id."""
    rng = np.random.default_rng(1)
    score = {"spread": lambda i: int(rng.integers(-1000, 1000)), "one": lambda i: 5, "two": lambda i: int(i % 3 == 0)}[values]
    rows = [(i, score(i)) for i in range(500)]
    pool = spark.createDataFrame(rows, "id long, score long")
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    for wanted in (1, 333):
        i, s = order[wanted - 1]
        assert R.cutoff(pool, 500, wanted, accuracy) == (s, i)


def test_parts_follow_the_order(spark):
    df = spark.range(5000).withColumn("k", F.col("id") * 7919 % 5000)
    parts = sorted_parts(df, [F.col("k").desc()], "test")
    starts = {p: b for p, b, _ in part_counts(parts)}
    assert all(starts[r.part] + r.row == 4999 - r.k for r in parts.collect())
