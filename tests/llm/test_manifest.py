import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from packlens.llm import manifest as M

COLS = ("doc_id", "source", "lang", "n_chars", "text")


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(row, arity):
    out = [row]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + arity])) for i in range(0, len(out[-1]), arity)])
    return out


def siblings(tree, i, arity):
    for row in tree[:-1]:
        at = i // arity * arity
        yield "".join(row[at:i]), "".join(row[i + 1 : at + arity])
        i //= arity


def brute(rows, arity=16):
    """rows: tuples of COLS, and whether the row is tampered with."""
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r[:5])))
        trees[s] = levels([leaf(r[:5]) for r in by[s]], arity)
    top = levels([trees[s][-1][0] for s in order], arity)
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(by[s]):
            path = [*siblings(trees[s], i, arity), *siblings(top, k, arity)]
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4]) if r[4] is not None else None
            node = leaf((*r[:4], low)) if r[5] else leaf(r[:5])
            for a, b in path:
                node = h(a + node + b)
            out.append((r[0], leaf(r[:5]), trees[s][-1][0], top[-1][0], h("".join(a + b for a, b in path)), node, node == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels_", range(1, 7))
@pytest.mark.parametrize("arity", [2, 3, 16])
def test_addresses_fill_the_layout_once(levels_, arity):
    if arity == 16 and levels_ > 4:
        return
    at = np.concatenate([M.address(levels_, d, np.arange(arity**d), arity) for d in range(levels_)])
    assert sorted(at) == list(range(M.nodes_in(levels_, arity)))


def test_subtrees_are_contiguous():
    """Split at half height: each lower part of a tree of four levels is one stretch of its own."""
    lower = M.nodes_in(2, 16)
    for root in (0, 1, 255):
        own = [*M.address(4, 2, np.array([root])), *M.address(4, 3, np.arange(16) + 16 * root)]
        assert max(own) - min(own) == lower - 1


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257])
def test_stored_blocks_give_runs_and_roots(n):
    row = [h(str(i)) for i in range(n)]
    depth = M.levels_for(n, 3, 16)
    b = M.Block(M.lay_out(row, depth, 16), n, depth, 16)
    assert b.run(0, 0) == [levels(row, 16)[-1][0]]
    for i, (left, right) in enumerate(b.paths()):
        assert list(zip(left, right, strict=True)) == list(siblings(levels(row, 16), i, 16))


def run(docs, **kw):
    return sorted(map(tuple, M.manifest(docs, tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, **kw).collect()), key=str)


def test_equal_to_brute_force_with_small_blocks(spark):
    """Arity 3 and blocks of 9 leaves: several rounds in one hot source, and a tree of many sources."""
    rows = [(i, "hot" if i % 3 else f"s{i % 40}", "en", i, f"Text {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    import zlib

    marked = [(*r, zlib.crc32(str(r[0]).encode()) % 5 == 0) for r in rows]
    got = run(docs, arity=3, height=2)
    assert got == brute(marked, 3)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)
    assert run(docs) == brute(marked)


def test_odd_rows(spark, odd_docs):
    import zlib

    docs = odd_docs.withColumn("n_chars", F.length("text").cast("long")).withColumnRenamed("kept", "tree").withColumn("pos", F.lit(1))
    rows = [tuple(r) for r in docs.select(*COLS).collect()]
    marked = [(*r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0) for r in rows]
    assert run(docs) == brute(marked)


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(5, None, None, None, None)], "doc_id long, source string, lang string, n_chars long, text string")
    (r,) = run(one)
    assert r[1] == r[2] == r[3] == r[5] == leaf((5, None, None, None, None)) and r[4] == h("") and r[6]
    assert run(one.limit(0)) == []


def test_any_change_shows(spark):
    docs = spark.createDataFrame([(i, "s", "en", 1, f"t{i}") for i in range(40)], "doc_id long, source string, lang string, n_chars long, text string")
    root = M.manifest(docs).first()["root"]
    for c, v in (("text", "x"), ("lang", None), ("n_chars", 2), ("source", "z")):
        other = docs.withColumn(c, F.when(F.col("doc_id") == 7, F.lit(v).cast(docs.schema[c].dataType)).otherwise(F.col(c)))
        assert M.manifest(other).first()["root"] != root
