import hashlib

from packlens.llm import exact_dedup
from pyspark.sql import functions as F


def brute(rows):
    norm = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    by = {}
    for i, t in rows:
        by.setdefault(norm(t), []).append(i)
    out = []
    for i, t in rows:
        ids = by[norm(t)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_odd_rows(odd_docs):
    assert got(exact_dedup.exact_groups(odd_docs)) == brute([(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()])


def test_whole_table(docs):
    assert got(exact_dedup.exact_groups(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_colliding_hashes_are_told_apart(odd_docs):
    weak = lambda c: (F.char_length(c) % 2).cast("string")
    assert got(exact_dedup.exact_groups(odd_docs, content_hash=weak)) == got(exact_dedup.exact_groups(odd_docs))


def test_smallest_and_keep_one(docs, odd_docs, no_docs):
    kept = exact_dedup.keep_one(docs, keep="smallest")
    ids = {r.doc_id for r in kept.collect()}
    low = {}
    for r in docs.collect():
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text)
        low[t] = min(low.get(t, r.doc_id), r.doc_id)
    assert ids == set(low.values()) and kept.columns == docs.columns
    assert exact_dedup.exact_groups(no_docs).count() == 0
    assert {r.doc_id for r in exact_dedup.keep_one(odd_docs).collect()} == {2, 4, 6, 7, 8, 9, 10}
