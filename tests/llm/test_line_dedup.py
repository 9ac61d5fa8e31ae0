import random

import duckdb
from packlens.llm import line_dedup as L
from packlens.llm import registry

from .conftest import make


def brute(texts, min_words=50):
    lines = [[(j, x) for j, x in enumerate((t or "").split("\n")) if x.strip(" ")] for t in texts]
    first, gone = {}, [set() for _ in texts]
    for d, ls in enumerate(lines):
        for i in range(len(ls)):
            for n in (1, 2):
                key = tuple(x for _, x in ls[i : i + n])
                if len(key) == n and first.setdefault(key, (d, i)) != (d, i) and (n == 2 or len(key[0].split()) >= min_words):
                    gone[d].update(j for j, _ in ls[i : i + n])
    return [sorted(g) for g in gone]


def runs(texts):
    rng = random.Random(5)
    body = [f"line {i}" for i in range(40)]
    return [*texts, *["\n".join(body[a : a + n]) for a, n in ((rng.randrange(40), rng.randrange(12)) for _ in range(60))], "\n".join(body), "\n".join(body), " ".join(["word"] * 60), "x\n" + " ".join(["word"] * 60), "a\na\na\na\na"]


def test_against_brute_force(spark):
    texts = runs(["one\ntwo\n\nthree", "zero\none\n\n\ntwo", None, "", "\n\n"])
    rows = {r.doc_id: r for r in L.dedup_lines(make(spark, texts)).collect()}
    for i, want in enumerate(brute(texts)):
        assert list(rows[i].deleted) == want and rows[i].n_deleted == len(want), i
    full = [i for i, t in enumerate(texts) if t == "\n".join(f"line {j}" for j in range(40))]
    assert rows[full[1]].max_depth == 32 and rows[full[1]].longest_run == 40


def test_suffix_order(spark):
    lines = L.numbered_lines(make(spark, ["a\nb\na\nb\na"]))
    levels = [{r.i: (r["rank"], r.n) for r in lv.collect()} for lv in L.suffix_levels(lines)]
    assert {i for i in levels[0]} == {0, 1, 2, 3, 4} and {i for i in levels[1]} == {0, 1, 2, 3}
    assert levels[1][0] == levels[1][2] and levels[1][1] == levels[1][3] and levels[1][0] != levels[1][1]
    assert len(levels) == 2


def test_cleaned_texts(spark, docs):
    texts = runs([])
    out = {r.doc_id: r.text for r in L.deduplicated(make(spark, texts)).collect()}
    for i, (t, gone) in enumerate(zip(texts, brute(texts), strict=True)):
        assert out[i] == "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone)
    want = brute([r.text for r in docs.orderBy("doc_id").collect()])
    got = {r.doc_id: list(r.deleted) for r in L.dedup_lines(docs).collect()}
    assert [got[i] for i in sorted(got)] == want


def test_odd_and_empty(odd_docs, no_docs):
    rows = L.dedup_lines(odd_docs, min_words=4).collect()
    assert len(rows) == odd_docs.count() and sum(r.n_deleted for r in rows) == 3  # a repeated row, the null id's text and the long copy
    assert L.dedup_lines(no_docs).count() == 0


def test_short_lines_of_many_documents(spark):
    texts = [f"own line number {i}\nSign up for our newsletter\nend {i}\nshort one\n" for i in range(8)] + ["Only in two places", "x\nOnly in two places"]
    rows = {r.doc_id: list(r.deleted) for r in L.dedup_lines(make(spark, texts), shared_by=7).collect()}
    assert rows == {i: [] if i in (0, 8, 9) else [1] for i in range(10)}
    assert all(not r.deleted for r in L.dedup_lines(make(spark, texts)).collect())
    once = {r.doc_id: list(r.deleted) for r in L.dedup_lines(make(spark, ["a b c\n\na b c\nz\na b c"] * 2), shared_by=3).collect()}
    assert once == {0: [], 1: [0, 2, 3, 4]}  # the copies in one document are one document


def test_shared_lines_query_against_its_sql(spark):
    df = registry.op5_line_dedup_shared(spark, "/root/testdata/sf0.001")
    duckdb.sql("CREATE OR REPLACE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    rel = duckdb.sql(registry.ORACLES["op5_line_dedup_shared"])
    got, want = ({r[rel.columns.index("doc_id")]: tuple(map(str, r)) for r in rows} for rows in (df.select(rel.columns).collect(), rel.fetchall()))
    assert got == want
    plain = sum(r.n_deleted for r in registry.op5_line_dedup(spark, "/root/testdata/sf0.001").collect())
    assert sum(int(r[rel.columns.index("n_deleted")]) for r in want.values()) > plain
