import random

import numpy as np
from packlens.llm import minhash as M

from .conftest import make


def brute(rows, k, percent=80):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {r[0]: (len(s), rows[root(i)][0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))}


def got(df, **how):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in M.near_duplicates(df, **how).collect()}


def noisy(seed=3):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(300)]
    texts = []
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice((1, 2, 3, 8, 40, 120)))]
        for _ in range(rng.choice((1, 2, 5))):
            texts.append(" ".join(w if rng.random() > 0.04 else rng.choice(vocab) for w in base))
    hub = [rng.choice(vocab) for _ in range(60)]  # many near copies, most of them at the threshold
    texts += [" ".join(w if rng.random() > 0.08 else rng.choice(vocab) for w in hub) for _ in range(60)]
    return texts


def test_against_brute_force(spark):
    texts = noisy()
    for k in (2, 5):
        assert got(make(spark, texts), k=k) == brute(list(enumerate(texts)), k)


def test_whole_table(docs):
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert got(docs, k=2) == brute(rows, 2)


def test_odd_and_empty(odd_docs, no_docs):
    rows = M.near_duplicates(odd_docs, k=2).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[2].component_id == 1 and by[6].component_id == 5 and by[3].component_id == 3 and by[3].n_shingles == 0
    assert by[10].n_shingles == 0 and by[7].n_shingles == 2 and by[8].component_id == 8
    assert [r.kept for r in rows if r.doc_id is None] == [True]
    assert M.near_duplicates(no_docs).count() == 0
    kept = M.keep_one(odd_docs, k=2)
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()} == {1, 3, 4, 5, 7, 8, 9, 10, None}


def test_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(100, 140)] + [(7, 3)], "a long, b long")
    found = {r.node: r.component for r in M.components(edges).collect()}
    assert {found[i] for i in range(101, 141)} == {100} and found[7] == 3


def test_bins_borrow_alike():
    a, b = M.shingle_set("one two three four five six", 2), M.shingle_set("one two three four five six seven", 2)
    share = np.mean([M.signature(a, 240) == M.signature(b, 240)])
    assert 0.6 < share <= 1


def late_pair():
    """Texts of which two, 0.8 alike, share buckets in bands from 16 on only; in each of these buckets there are
    30 others, unlike all, and the two are no centre of any."""
    rng, bins = random.Random(11), M.BANDS * M.ROWS
    bin_of = lambda w: (int(M.shingle_set(w, 1)[0]) >> 32) * bins >> 32
    for t in range(20_000):
        a = [f"t{t}w{i}" for i in range(700)]
        gone = set(rng.sample(range(700), 72))
        b = [w for i, w in enumerate(a) if i not in gone] + [f"t{t}x{i}" for i in range(72)]
        sa, sb = (M.shingle_set(" ".join(w), 1) for w in (a, b))
        same = np.flatnonzero(M.band_keys(sa, M.BANDS, M.ROWS) == M.band_keys(sb, M.BANDS, M.ROWS))
        if not len(same) or same[0] < 16:
            continue
        least = {}
        for w in a:
            least[bin_of(w)] = min(least.get(bin_of(w), (2**64, "")), (int(M.shingle_set(w, 1)[0]), w))
        shared = {j for s in same for j in range(s * M.ROWS, (s + 1) * M.ROWS)}
        if shared <= set(least):
            break
    common = [least[j][1] for j in sorted(shared)]
    others = [common + [w for w in (f"o{n}y{i}" for i in range(3 * len(common))) if bin_of(w) not in shared] for n in range(30)]
    keys = M.band_keys(sa, M.BANDS, M.ROWS)[same].tolist()
    while True:
        ids = rng.sample(range(1000), 32)
        if all(not {ids[0], ids[1]} & {min(ids, key=lambda i: i ^ k), max(ids, key=lambda i: i ^ k)} for k in keys):
            return list(zip(ids, map(" ".join, [a, b, *others]), strict=True))


def test_links_of_late_bands(spark, monkeypatch):
    rows = late_pair()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 1)
    assert want[rows[0][0]][1] == want[rows[1][0]][1]
    same = lambda g: {(frozenset(i for i in g if g[i][1] == c)) for _, c in g.values()}
    assert same(got(df, k=1)) == same(want)
    monkeypatch.setattr(M, "BLOCK_ROWS", 5)
    assert same(got(df, k=1)) == same(want)


def test_prefix_keys_meet_for_every_link():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 120))
        base = rng.integers(0, 2**63, 2 * n, dtype=np.int64).view(np.uint64)
        cut = int(n * rng.uniform(0, 0.25))
        a, b = np.unique(base[:n]), np.unique(base[cut : n + int(rng.integers(0, 2)) * cut])
        both = len(np.intersect1d(a, b))
        rank = lambda s: (s % np.uint64(7)).astype(np.int64)
        (ka, la), (kb, lb) = (M.prefix_keys(s, rank(s), 80) for s in (a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            assert set(ka[~la]) & set(kb[lb]) or set(kb[~lb]) & set(ka[la])


def test_all_links_through_prefixes_and_blocks(spark, monkeypatch):
    texts = noisy(8)
    want = brute(list(enumerate(texts)), 2)
    monkeypatch.setattr(M, "SMALL", 1)
    monkeypatch.setattr(M, "BLOCK_ROWS", 7)
    monkeypatch.setattr(M, "_star_pairs", lambda keys: M._distinct_pairs(keys.limit(0).selectExpr("rep as x", "rep as y")))
    assert got(make(spark, texts), k=2) == want


def test_many_short_texts_of_one_pattern(spark):
    """5 shingles each, 4 of them common to all: 0.67 alike, so unlinked, but most share buckets."""
    n = 20_000
    df = spark.range(n).selectExpr("id as doc_id", "concat('page not found on server ', id) as text").union(
        spark.createDataFrame([(n + 5, "Page not found on server 7"), (n + 6, "page not found on server 9 today"), (n + 7, "page not found on server")], "doc_id long, text string")
    )
    out = {r.doc_id: r.component_id for r in M.near_duplicates(df, k=2).filter("not kept").collect()}
    # four of five shingles are 0.8: the text without a number is linked with all that have one
    assert set(out.values()) == {0} and len(out) == n + 2


def test_ids_of_other_types(spark):
    texts = noisy(4)[:60]
    names = [f"d{i:03}" for i in range(len(texts))]
    df = spark.createDataFrame([*zip(names, texts), (None, texts[0])], "doc_id string, text string")
    rows = M.near_duplicates(df, k=2).collect()
    want = {names[i]: (n, names[c]) for i, (n, c) in brute(list(enumerate(texts)), 2).items()}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id} == want and all(r.kept == (r.doc_id == r.component_id) for r in rows if r.doc_id)
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]


def test_keys_are_dealt_out_once(spark, monkeypatch):
    """Bucket keys and prefix keys are grouped and joined by one exchange, which is read twice."""
    plans, cut = {}, M.cut

    def spy(df, label):
        if label in ("members", "crossed"):
            df.collect()
            plans[label] = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        return cut(df, label)

    monkeypatch.setattr(M, "cut", spy)
    monkeypatch.setattr(M, "SMALL", 2)
    texts = noisy()
    assert got(make(spark, texts), k=2) == brute(list(enumerate(texts)), 2)
    for label in ("members", "crossed"):
        by_key = [line for line in plans[label].splitlines() if "Exchange hashpartitioning" in line and "key#" in line and "Reused" not in line]
        assert len(by_key) == 1 and "REPARTITION_BY_COL" in by_key[0] and "ReusedExchange" in plans[label]
