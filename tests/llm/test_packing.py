import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from packlens.llm import packing as P
from packlens.llm import registry
from tokenizers import Tokenizer

from .conftest import make

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def check(df, out, seq_len=1024):
    tok = Tokenizer.from_file(JSON)
    ids = [([*tok.encode(r.text or "", add_special_tokens=False).ids, 0], r.doc_id) for r in df.select("doc_id", "text").collect()]
    rows = out.collect()
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    assert sorted(by) == list(range(len(by)))
    for s, ps in by.items():
        ps.sort(key=lambda r: r.offset)
        at = 0
        for r in ps:
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == seq_len or s == len(by) - 1
    if len({i for _, i in ids}) == len(ids):
        of = {i: x for x, i in ids}
        seen = defaultdict(list)
        for r in rows:
            seen[r.doc_id].append(r)
        for i, x in of.items():
            at = 0
            for r in sorted(seen[i], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(x)
                assert r.ids_crc32 == zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes())
                at += r.length
            assert at == len(x)
    assert sum(r.length for r in rows) == sum(len(x) for x, _ in ids)
    return rows


def served(rows, seq_len=1024):
    """Documents in the order of the stream: (id, queue, window, tokens), and the tokens before each."""
    heads = sorted((r.sequence_id * seq_len + r.offset, r.doc_id, r.queue, r.window, r.doc_tokens) for r in rows if r.start == 0)
    return [h[1:] for h in heads], [h[0] for h in heads]


def round_robin(queues, quantum):
    """Deficit round-robin as a loop. queues: name -> [(id, tokens)]; quantum: name -> tokens a window."""
    out, deficit, at, window = [], dict.fromkeys(queues, 0.0), dict.fromkeys(queues, 0), 0
    while any(at[q] < len(x) for q, x in queues.items()):
        window += 1
        for q in sorted(queues):
            if at[q] == len(queues[q]):
                continue  # dry
            deficit[q] += quantum[q]
            while at[q] < len(queues[q]) and queues[q][at[q]][1] <= deficit[q] + 1e-6:
                i, n = queues[q][at[q]]
                out.append((i, q, window, n))
                deficit[q] -= n
                at[q] += 1
    return out


def simulated(order, weights=None, temper=1.0, window=16 * 1024):
    """The schedule of the loop for the queues as they stand in order."""
    queues = defaultdict(list)
    for i, q, _, n in order:
        queues[q].append((i, n))
    w = {q: (sum(n for _, n in x) ** temper if weights is None else weights[q]) for q, x in queues.items()}
    return round_robin(queues, {q: v / sum(w.values()) * window for q, v in w.items()})


def test_round_trip_and_schedule(docs):
    df = docs.repartition(5, "doc_id")
    for how in ({}, {"temper": 0.7, "window_sequences": 2}, {"weights": {f"src{i}": 1.0 + i for i in range(100)}, "window_sequences": 4}):
        out = P.pack(df, JSON, RANKS, **how)
        order, _ = served(check(df, out))
        want = simulated(order, how.get("weights"), how.get("temper", 1.0), 1024 * how.get("window_sequences", 16))
        assert order == want, how


def test_query_serves_its_mixture(spark, docs):
    rows = registry.op6_packing(spark, "/root/testdata/sf0.001").collect()
    order, _ = served(rows)
    assert order == simulated(order, temper=registry.TEMPER)
    assert len(rows) <= docs.count() + max(r.sequence_id for r in rows) + 1  # documents are cut at the ends of sequences only


def test_odd_and_empty(odd_docs, no_docs, spark):
    check(odd_docs, P.pack(odd_docs, JSON, RANKS, seq_len=64, window_sequences=2), 64)
    assert P.pack(no_docs, JSON, RANKS).count() == 0
    odd = make(spark, ["a<|endoftext|>b", "नमस्ते   दुनिया", "x\x1cy\x85z", "naïve  café\n\n ok", "don't WE'LL 123 ..."])
    check(odd, P.pack(odd, JSON, RANKS))


def test_windows_hold_target_proportions(docs):
    """Up to any window a queue that is not dry has its share, but for less than the document that it waits for."""
    order, _ = served(P.pack(docs, JSON, RANKS, temper=0.5).collect())
    total, done, last = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, q, w, n in order:
        total[q] += n
        last[q] = w
    share = {q: n**0.5 / sum(x**0.5 for x in total.values()) * 16 * 1024 for q, n in total.items()}
    for w in range(1, max(last.values()) + 1):
        for _, q, win, n in order:
            done[q] += n * (win == w)
        for q in total:
            if w < last[q]:
                following = next(n for _, p, win, n in order if p == q and win > w)
                assert -1e-6 <= w * share[q] - done[q] < following


plain = st.text(st.characters(codec="utf-8", categories=("L", "N", "P", "S", "Z", "C")).filter(lambda c: not P._PLAIN.search(c)), max_size=80)


@settings(max_examples=1500, deadline=None)
@given(plain)
def test_both_libraries_give_the_same_ids(text):
    if "<|" not in text:
        assert P.encoder(JSON, RANKS)(text).tolist() == P.encoder(JSON, None)(text).tolist()


def test_all_pairs_of_admitted_characters():
    chars = [chr(c) for c in range(0x250) if not P._PLAIN.search(chr(c))]
    text = " ".join(a + b for a in chars for b in "aZ9.' \n" + "é") + "".join(chars)
    assert P.encoder(JSON, RANKS)(text).tolist() == P.encoder(JSON, None)(text).tolist()


def test_one_queue_for_each_of_many_sources(spark):
    rows = [(i, " word" * (6000 if i == 7 else 5), f"site{i}") for i in range(1100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = {f"site{i}": 1099.0 if i == 7 else 1.0 for i in range(1100)}
    got = check(df, P.pack(df, JSON, RANKS, weights=weights, seq_len=512, window_sequences=8), 512)
    assert {r.queue for r in got} == {s for _, _, s in rows} and all(r.queue == f"site{r.doc_id}" for r in got)
    order, _ = served(got, 512)
    assert order == simulated(order, weights, window=4096)


def test_sources_without_a_weight_come_late(docs):
    names = sorted({r.source for r in docs.select("source").collect()})
    order, _ = served(P.pack(docs, JSON, RANKS, weights={names[0]: 1.0}, window_sequences=1).collect())
    own = [q == names[0] for _, q, _, _ in order]
    assert sum(own) == docs.filter(docs.source == names[0]).count() and not any(own[sum(own) :])
    assert {q for _, q, _, _ in order} == set(names)
    with pytest.raises(StopIteration):
        next(x for x in order if x[2] < 1)
