"""Near-duplicate detection: one-permutation hashing with optimal densification, banded buckets and
star-shaped candidate edges, confirmed on full shingle sets.

Equal sets are one class, so copies never meet as pairs. In each bucket every class is paired with two
centres only, chosen by a mask that differs from bucket to bucket: the number of pairs is linear in
the number of members. Confirmed links give components. A bucket whose members are still in different
components is looked at again, so that centres that differ from two like members don't lose their
link: all open pairs are confirmed if it is small, else its members take part in an exact similarity
join by prefixes of their shingles, rare ones first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, maybe_broadcast, without

BANDS, ROWS = 40, 6
_U = np.uint64


class _WordHash(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _WordHash()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a whole text, A-Z lower-cased, words apart
    by ASCII white space. Fewer words than k: the whole sequence is one shingle. No words: empty."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, _U)
    h = np.fromiter(map(_words.__getitem__, w), _U, len(w))
    n = min(k, len(h))
    acc = np.full(len(h) - n + 1, n, _U)
    for i in range(n):
        acc = _mix(acc * _U(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return np.unique(acc)


@cache
def _probes(bins: int) -> np.ndarray:
    """For every bin the order in which it looks for a filled bin: the same in all processes."""
    rng = np.random.default_rng(20_011)
    return np.stack([rng.permutation(bins) for _ in range(bins)]).astype(np.int32)


def signature(shingles: np.ndarray, bins: int) -> np.ndarray:
    """Minimum per bin of one permutation; an empty bin borrows from the first filled bin of its own
    random order (optimal densification)."""
    bin_of = ((shingles >> _U(32)) * _U(bins)) >> _U(32)
    first = np.flatnonzero(np.diff(bin_of, prepend=_U(bins)))  # shingles are sorted, so these are the minima
    sig, filled = np.zeros(bins, _U), np.zeros(bins, bool)
    at = bin_of[first].astype(np.int64)
    sig[at], filled[at] = shingles[first], True
    empty = np.flatnonzero(~filled)
    for width in (16, bins):
        if len(empty):
            order = _probes(bins)[empty, :width]
            ok = filled[order]
            has = ok.any(1)
            sig[empty[has]] = sig[order[has, ok[has].argmax(1)]]
            empty = empty[~has]
    return sig


def band_keys(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    sig = signature(shingles, bands * rows).reshape(bands, rows)
    acc = np.arange(1, bands + 1, dtype=_U)
    for i in range(rows):
        acc = _mix(acc * _U(0x9E3779B97F4A7C15) + sig[:, i])
    return acc.view(np.int64)


def sketches(docs: DataFrame, k: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, f1, f2, bands) per row; f1, f2: 128-bit fingerprint of the set, null if it is empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text in b["text"]:
                s = shingle_set(text, k)
                if not len(s):
                    out.append((0, None, None, None))
                    continue
                f = xxhash.xxh3_128_digest(s.tobytes())
                out.append((len(s), *np.frombuffer(f, np.int64).tolist(), band_keys(s, bands, rows)))
            cols = pd.DataFrame(out, columns=["n_shingles", "f1", "f2", "bands"])
            cols["f1"], cols["f2"] = cols["f1"].astype("Int64"), cols["f2"].astype("Int64")
            yield pd.concat([b[["id"]].reset_index(drop=True), cols], axis=1)

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return src.mapInPandas(run, "id bigint, n_shingles bigint, f1 bigint, f2 bigint, bands array<bigint>")


def confirm(pairs: DataFrame, docs: DataFrame, sizes: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union. sizes: per id the
    largest (n) and least (least) number of shingles; pairs too far apart in it are never compared."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    ids = cut(ids.join(sizes.withColumnRenamed("rep", "id"), "id"), "ids")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(maybe_broadcast(ids, ids.count()), "id")
    side = lambda x: texts.select(*[F.col(c).alias(f"{n}{x}") for c, n in (("id", ""), ("text", "t"), ("n", "n"), ("least", "l"))])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.filter((F.col("la") * percent <= F.col("nb") * 100) & (F.col("lb") * percent <= F.col("na") * 100))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, last_set = None, np.empty(0, _U)
        for batch in batches:
            good = []
            for ta, tb in zip(batch["ta"], batch["tb"], strict=True):
                if tb is not last:
                    last_set = last_set if tb == last else shingle_set(tb, k)
                    last = tb
                s = shingle_set(ta, k)
                both_n = len(np.intersect1d(s, last_set, assume_unique=True))
                good.append(both_n > 0 and 100 * both_n >= percent * (len(s) + len(last_set) - both_n))
            yield batch.loc[np.array(good, bool), ["a", "b"]]

    return both.select("a", "b", "ta", "tb").mapInPandas(run, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b). Large-star and small-star steps
    alternate until the edges no longer change; every step is cut, nothing goes to the driver but sums."""
    state = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state, seen = cut(state, "edges"), None
    while True:
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
        sym = state.union(state.select("v", "u"))  # large star: larger neighbours go to the least one
        least = sym.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = sym.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))  # small star: smaller neighbours meet in the least
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        state = cut(small.filter("u <> v").distinct(), "small")
    return state.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


def _distinct_pairs(df: DataFrame) -> DataFrame:
    return df.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


#: Buckets of up to so many members, and prefix keys of up to so many in one role, have their open pairs listed.
SMALL = 8
#: Shingles and rows in a block, about.
BLOCK, BLOCK_ROWS = 200_000, 2048
#: Counters of the frequency sketch that orders shingles; a fixed size.
SKETCH_BITS = 16


def _centres(members: DataFrame) -> DataFrame:
    """(key, lo, hi): two members of each key that has several, chosen by their ids under a mask that differs
    from key to key."""
    masked = F.col("rep").bitwiseXOR(F.col("key"))
    two = members.groupBy("key").agg(F.min(masked).alias("lo"), F.max(masked).alias("hi")).filter("lo <> hi")
    return two.withColumns({c: F.col(c).bitwiseXOR(F.col("key")) for c in ("lo", "hi")})


def least_overlap(a, b, percent: int):
    """Fewest common shingles of linked sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


@cache
def _size_classes() -> np.ndarray:
    """Least size of every class: one class a size up to 32, then classes 4 % wide."""
    edges = list(range(33))
    while edges[-1] < 2**31:
        edges.append(max(edges[-1] + 1, int(edges[-1] * 1.04)))
    return np.array(edges, np.int64)


def prefix_keys(shingles: np.ndarray, rank: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, large): what a set must share with a set that it is linked to.

    Shingles are put in one order for all sets (rank, then value; rare ones first). Of two linked sets of sizes
    a <= b, the first a - o + 1 shingles of one and the first b - o + 1 of the other have one in common, o being
    their least overlap. A set is filed as the smaller one under its own size class (large false), and as the
    larger one under every class that its partners may be of. The bounds take a class by its least size, so
    no link is lost.
    """
    n, edges = len(shingles), _size_classes()
    order = shingles[np.lexsort((shingles, rank))]
    low = -(-percent * n // 100)
    own, first = (int(np.searchsorted(edges, x, "right")) - 1 for x in (n, low))
    salt = lambda c: _U(c * 0x9E3779B97F4A7C15 % 2**64)
    parts, large = [_mix(order[: n - least_overlap(n, n, percent) + 1] + salt(own))], [False]
    for c in range(first, own + 1):
        take = n - least_overlap(max(int(edges[c]), low), n, percent) + 1
        parts.append(_mix(order[:take] + salt(c)))
        large.append(True)
    return np.concatenate(parts).view(np.int64), np.repeat(large, [len(p) for p in parts])


def _filed(open_: DataFrame, docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(sets, keys) of open_ (rep, comp): sets (rep, comp, n, set) and keys (key, rep, comp, large).

    Shingles are ordered by a sketch of their frequencies among these sets, 2**SKETCH_BITS counters, whatever
    the size of the table; the order decides how many candidates there are, never which links are found.
    """
    texts = docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text")).join(maybe_broadcast(open_, open_.count()), "rep")

    def to_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingle_set(t, k) for t in b["text"]]
            yield pd.DataFrame({"rep": b["rep"], "comp": b["comp"], "n": [len(s) for s in sets], "set": [s.view(np.int64) for s in sets]})

    sets = cut(texts.mapInPandas(to_sets, "rep bigint, comp bigint, n bigint, `set` array<bigint>"), "sets")
    seen = sets.select(F.explode("set").alias("s")).select(F.shiftrightunsigned("s", 64 - SKETCH_BITS).cast("int").alias("s"))
    counted = seen.groupBy("s").agg(F.count("*").alias("n")).toPandas()  # 2**SKETCH_BITS rows at most
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    counts[counted["s"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for rep, comp, s in zip(b["rep"], b["comp"], b["set"], strict=True):
                s = np.asarray(s, np.int64).view(_U)
                keys, large = prefix_keys(s, shared.value[(s >> _U(64 - SKETCH_BITS)).astype(np.int64)], percent)
                yield pd.DataFrame({"key": keys, "rep": rep, "comp": comp, "large": large})

    keys = sets.select("rep", "comp", "set").mapInPandas(file, "key bigint, rep bigint, comp bigint, large boolean")
    return sets, cut(keys, "keys").repartition("key").distinct()  # dealt out once: _crossed groups and joins by the same key


def _crossed(keys: DataFrame) -> DataFrame:
    """keys with m0 and m1, the members as smaller and as larger set, where a link between components may be."""
    per = keys.groupBy("key").agg(
        F.count_if(~F.col("large")).alias("m0"), F.count_if("large").alias("m1"), F.min("comp").alias("c0"), F.max("comp").alias("c1")
    )
    return keys.join(per.filter("m0 > 0 AND m1 > 0 AND c0 <> c1").select("key", "m0", "m1"), "key")


def _retagged(keys: DataFrame, comps: DataFrame) -> DataFrame:
    return keys.drop("comp").join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")


def _listed_pairs(keys: DataFrame, few: Column) -> DataFrame:
    """All pairs (a, b) of different components and roles under the keys where few holds."""
    sides = [keys.filter(few & (F.col("large") == x)).select("key", F.col("rep").alias(n), F.col("comp").alias(f"c{n}")) for x, n in ((False, "x"), (True, "y"))]
    return _distinct_pairs(sides[0].join(sides[1], "key").filter("cx <> cy"))


def _star_pairs(keys: DataFrame) -> DataFrame:
    """Pairs (a, b) of every member with two members in the other role, chosen by a mask that differs from key to key."""
    two = [_centres(keys.filter(F.col("large") == x).select("key", "rep")).withColumn("large", F.lit(not x)) for x in (False, True)]
    with_centres = keys.join(two[0].union(two[1]), ["key", "large"])
    return _distinct_pairs(with_centres.select(F.col("rep").alias("x"), F.explode(F.array("lo", "hi")).alias("y")))


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of left with each of right. Only shingles that occur on both sides are
    columns of the product."""
    a, b = np.concatenate(left), np.concatenate(right)
    ra, rb = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right))
    both = np.intersect1d(a, b)
    ca, cb = (np.minimum(np.searchsorted(both, x), max(0, len(both) - 1)) for x in (a, b))
    ok_a, ok_b = (both[c] == x if len(both) else np.zeros(len(x), bool) for c, x in ((ca, a), (cb, b)))
    out = np.zeros((len(left), len(right)), np.float32)
    (ra, ca), (rb, cb) = ((r[ok][o], c[ok][o]) for r, c, ok, o in ((r, c, ok, np.argsort(c[ok], kind="stable")) for r, c, ok in ((ra, ca, ok_a), (rb, cb, ok_b))))
    for lo in range(0, len(both), 2048):
        x, y = np.zeros((len(left), 2048), np.float32), np.zeros((len(right), 2048), np.float32)
        for m, r, c in ((x, ra, ca), (y, rb, cb)):
            at = slice(*np.searchsorted(c, [lo, lo + 2048]))
            m[r[at], c[at] - lo] = 1
        out += x @ y.T
    return out.astype(np.int64)


def _links_in_blocks(large: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) of different components within the buckets of large (key, rep, n, comp).

    A bucket is cut into blocks of about BLOCK shingles and BLOCK_ROWS rows, and every pair of blocks is one group, in
    which only links are listed. Members of the component that most of a group belongs to are compared with
    the others only.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.sum("n") / BLOCK), F.ceil(F.count("*") / BLOCK_ROWS)).cast("int").alias("blocks")
    placed = large.join(large.groupBy("key").agg(blocks), "key").withColumn("own", F.pmod(F.xxhash64("rep", "key"), F.col("blocks")).cast("int"))
    to = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, "own").alias("i"), F.greatest(x, "own").alias("j")))
    dealt = placed.select("key", "rep", "comp", "own", F.inline(to)).join(sets.select("rep", "set"), "rep")

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        found = [np.empty((2, 0), np.int64)]
        names, count = np.unique(g["comp"], return_counts=True)
        rest = g["comp"] != names[count.argmax()]
        left, right = g["own"] == key[1], g["own"] == key[2]
        for one, other in ((left & rest, right), (left & ~rest, right & rest)):
            a, b = g[one], g[other]
            if not len(a) or not len(b):
                continue
            sa, sb = ([np.asarray(s, np.int64) for s in x["set"]] for x in (a, b))
            na, nb = (np.array([len(s) for s in x]) for x in (sa, sb))
            both = _overlaps(sa, sb)
            ok = (both > 0) & (100 * both >= percent * (na[:, None] + nb - both)) & (a["comp"].to_numpy()[:, None] != b["comp"].to_numpy())
            x, y = np.nonzero(ok)
            found.append(np.stack([a["rep"].to_numpy()[x], b["rep"].to_numpy()[y]]))
        x, y = np.concatenate(found, axis=1)
        return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return dealt.groupBy("key", "i", "j").applyInPandas(run, "a bigint, b bigint").distinct()


def _mixed(members: DataFrame, comps: DataFrame) -> DataFrame:
    """(key, rep, n, comp, m): the buckets whose m members are in different components."""
    tagged = members.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("comp"))
    mixed = tagged.groupBy("key").agg(F.count("*").alias("m"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1").select("key", "m")
    return tagged.join(mixed, "key")


def _merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """comps (node, component) after the links (a, b) between nodes; the graph of their components is small."""
    for side in ("a", "b"):
        named = comps.select(F.col("node").alias(side), F.col("component").alias("c"))
        links = links.join(named, side, "left").withColumn(side, F.coalesce("c", side)).drop("c")
    again = cut(components(links), "again")
    to = again.select(F.col("node").alias("component"), F.col("component").alias("to"))
    moved = comps.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return cut(moved.union(again.select("node", "component")), "components")  # a least node is in no row of comps


def _small_pairs(small: DataFrame) -> DataFrame:
    """All pairs (a, b) of different components in buckets of at most SMALL members."""
    other = small.select("key", F.col("rep").alias("y"), F.col("comp").alias("comp2"))
    return _distinct_pairs(small.join(other, "key").filter("comp < comp2").select(F.col("rep").alias("x"), "y"))


def _rest_by_prefix(large: DataFrame, comps: DataFrame, docs: DataFrame, sizes: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """comps after all links between the members of large (key, rep, n, comp), buckets in several components.

    Linked sets share a prefix key as well as a bucket. Under prefix keys with few members in one role, pairs are
    listed; under the others stars come first. Only sets that then still share a frequent prefix key with another
    component are compared block by block, within their buckets.
    """
    open_ = cut(large.select("rep", "comp").distinct(), "large")
    if open_.isEmpty():
        return comps
    sets, keys = _filed(open_, docs, k, percent, id_col, text_col)
    crossed = cut(_crossed(keys), "crossed")
    few = F.least("m0", "m1") <= SMALL
    pairs = _listed_pairs(crossed, few).union(_star_pairs(crossed.filter(~few)))
    comps = _merged(comps, confirm(cut(pairs.distinct(), "listed"), docs, sizes, k, percent, id_col, text_col))
    hot = cut(_crossed(_retagged(crossed.filter(~few).drop("m0", "m1"), comps)).select("rep").distinct(), "hot")
    if hot.isEmpty():
        return comps
    left = cut(_mixed(large.select("key", "rep", "n").join(hot, "rep", "left_semi"), comps), "left")
    return _merged(comps, cut(_links_in_blocks(left, sets, percent), "links"))


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """docs as (id bigint, text). Ids of other types than whole numbers are numbered; then also (id, name)."""
    kind = docs.schema[id_col].dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")), None
    names = docs.select(F.col(id_col).alias("name")).dropna().distinct().withColumn("id", F.monotonically_increasing_id())
    names = cut(names, "names")
    return docs.select(F.col(id_col).alias("name"), F.col(text_col).alias("text")).join(names, "name", "left").select("id", "text"), names


def near_duplicates(
    docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable, itself included), kept.

    Null and empty texts have no shingles and are linked with nothing. Rows with a null id take no
    part: component_id null, kept true. Rows that share an id are one node, linked to whatever any of
    their texts is linked to; so are repeated rows. Ids may be of any type that has an order. Texts of any length are
    read whole; an empty table gives an empty result; other columns are ignored, whatever their names. With the
    defaults a pair at a similarity of exactly 0.8 shares no bucket with a chance of about 5 in a million; links
    between members of one bucket are all found, and confirmed on full sets.
    """
    docs, names = _numbered(docs, id_col, text_col)
    sk = cut(sketches(docs, k, bands, rows, "id", "text"), "sketches")
    real = sk.filter("n_shingles > 0 AND id IS NOT NULL")
    classes = cut(real.groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.max("n_shingles").alias("n")), "classes")
    of = cut(sk.select("id", "n_shingles", "f1", "f2").join(classes.select("f1", "f2", "rep"), ["f1", "f2"], "left").select("id", "n_shingles", "rep"), "of")
    reps = real.join(classes.select("f1", "f2", F.col("rep").alias("id")), ["f1", "f2", "id"])
    # the bulk of all shuffled bytes: dealt out by key once, both for the centres and for the join with them
    keyed = reps.select(F.col("id").alias("rep"), F.explode("bands").alias("key")).repartition("key")
    sizes = classes.groupBy("rep").agg(F.max("n").alias("n"), F.min("n").alias("least"))
    members = cut(keyed.join(_centres(keyed).hint("merge"), "key").distinct().join(sizes.select("rep", "n"), "rep"), "members")
    stars = _distinct_pairs(members.select(F.col("rep").alias("x"), F.explode(F.array("lo", "hi")).alias("y")))
    stars = cut(stars, "stars")
    comps = cut(components(confirm(stars, docs, sizes, k, percent, "id", "text")), "components")
    open_ = cut(_mixed(members, comps), "open")
    rest = cut(_small_pairs(open_.filter(F.col("m") <= SMALL)).join(stars, ["a", "b"], "left_anti"), "rest")
    comps = _merged(comps, confirm(rest, docs, sizes, k, percent, "id", "text"))
    large = cut(_mixed(open_.filter(F.col("m") > SMALL).select("key", "rep", "n"), comps), "mixed")
    comps = _rest_by_prefix(large, comps, docs, sizes, k, percent, "id", "text")
    end = of.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("id", "n_shingles", F.coalesce("component", "rep", "id").alias("component_id"))
    if names is not None:  # the smallest name of each component
        named = end.select("id", "n_shingles", "component_id").join(names, "id", "left")
        least = named.groupBy("component_id").agg(F.min("name").alias("least"))
        end = named.join(least, "component_id", "left").select(F.col("name").alias("id"), "n_shingles", F.when(F.col("name").isNotNull(), F.col("least")).alias("component_id"))
    return end.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """docs with one document of each component, the one with the smallest id."""
    gone = cut(near_duplicates(docs, id_col=id_col, **how).filter(~F.col("kept")).select(id_col).distinct(), "gone")
    return without(docs, gone, [id_col])
