import zlib
from collections import defaultdict

import numpy as np
import pyspark.sql.functions as F
from packlens.llm import sharding as S

from .conftest import make


def check(df, out, n):
    want = sorted(((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in df.select("doc_id", "text").collect()), key=str)
    rows = out.collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=str) == want
    slots = defaultdict(list)
    for r in rows:
        assert r.law == "bytes" and 0 <= r.shard < n and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return rows


def loads(rows):
    out = np.zeros((8, 3))
    for r in rows:
        out[r.shard] += (r.size, r.tokens, 1)
    return out / out.mean(0)


def brute(groups, shards, weights):
    """Groups (key, bytes, tokens, rows) by name, largest first, each where the dot product with what is missing is highest."""
    sums = [sum(g[i] for g in groups) for i in (1, 2, 3)]
    missing, where = [[w / shards for w in weights] for _ in range(shards)], {}
    for g in sorted(sorted(groups), key=lambda g: -g[1]):
        load = [w * g[i + 1] / sums[i] for i, w in enumerate(weights)]
        score = [sum(m * x for m, x in zip(missing[s], load)) for s in range(shards)]
        s = where[g[0]] = max(range(shards), key=lambda k: (round(score[k], 15), -k))
        missing[s] = [m - x for m, x in zip(missing[s], load)]
    return where


def test_placement_against_brute_force(docs):
    """At this size every group is placed as itself."""
    text = F.coalesce("text", F.lit(""))
    keys = {r.doc_id: (f"{r.h}/0", r.t) for r in docs.select("doc_id", text.alias("t"), F.xxhash64(text).alias("h")).collect()}
    groups = defaultdict(lambda: [0, 0, 0])
    for k, t in keys.values():
        groups[k] = [a + b for a, b in zip(groups[k], (len(t.encode()) + 1, len(t.split()), 1))]
    where = brute([(k, *v) for k, v in groups.items()], 8, (1.0, 0.5, 0.25))
    rows = check(docs, S.shard(docs), 8)
    assert [r.shard for r in rows] == [where[keys[r.doc_id][0]] for r in rows]


def test_all_three_are_balanced_and_groups_stay_whole(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for how, most in (({}, (1.01, 1.02, 1.03)), ({"buckets": 512}, (1.02, 1.03, 1.05))):  # the second gathers small groups in bundles
        rows = check(docs, S.shard(docs, **how), 8)
        part, of = loads(rows), defaultdict(set)
        for r in rows:
            of[r.text_crc32].add(r.shard)
        assert (part.max(0) <= most).all() and all(len(s) == 1 for s in of.values())


def test_large_group_stays_whole_while_it_fits(spark):
    """600 of 6,600 rows, about 0.9 of a shard's part of the bytes."""
    df = make(spark, ["same text " * 12] * 600 + [f"text {i} " * 10 for i in range(6000)])
    rows = check(df, S.shard(df), 8)
    of = {r.shard for r in rows if r.size == 121}
    assert len(of) == 1 and loads(rows)[:, 0].max() <= 1.01


def test_group_that_fits_nowhere_is_split(spark):
    df = make(spark, ["same text " * 20] * 600 + [f"text {i} " * 10 for i in range(600)])
    rows = check(df, S.shard(df), 8)
    size = np.zeros(8)
    for r in rows:
        size[r.shard] += r.size
    assert size.max() <= 1.1 * size.mean()


def test_odd_and_empty(odd_docs, no_docs):
    check(odd_docs, S.shard(odd_docs), 8)
    assert S.shard(no_docs).count() == 0
