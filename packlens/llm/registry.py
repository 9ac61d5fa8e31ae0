"""Queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, language_id, license_scan, line_dedup, manifest, minhash, packing, resample, secret_scan, sharding, url_filter, vantage


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return license_scan.scan(docs, license_scan.train(docs))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return language_id.predict(docs, language_id.train(docs))


def _digits(c, n: int):
    """A number below 65536 from a text, which SQL can repeat."""
    return F.conv(F.substring(F.md5(c), n, 4), 16, 10).cast("int")


def url_list(pages: DataFrame) -> DataFrame:
    """Dated entries made from the captured hosts: some hosts, sections of hosts and one domain are listed,
    taken off and listed again on days that depend on their names."""
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("host"), F.regexp_extract("url", r"^https?://[^/?#]+/([^/?#]+)", 1).alias("part")).distinct()
    day = lambda c, n: F.timestamp_add("DAY", _digits(c, n) % 300, F.lit("2024-01-01").cast("timestamp"))
    h, p = F.col("host"), F.concat_ws("/", "host", "part")
    made = [
        hosts.filter(_digits(h, 1) % 5 == 0).select(F.lit("host").alias("kind"), h.alias("pattern"), F.lit("add").alias("action"), day(h, 5).alias("at")),
        hosts.filter(_digits(h, 1) % 10 == 0).select(F.lit("host"), h, F.lit("remove"), F.timestamp_add("DAY", F.lit(40), day(h, 5))),
        hosts.filter(_digits(h, 1) % 20 == 0).select(F.lit("host"), h, F.lit("add"), F.timestamp_add("DAY", F.lit(70), day(h, 5))),
        hosts.filter((F.col("part") != "") & (_digits(p, 1) % 7 == 0)).select(F.lit("prefix"), p, F.lit("add"), day(p, 5)),
        hosts.filter(h.like("%.example.net")).limit(1).select(F.lit("domain"), F.lit("example.net"), F.lit("add"), F.lit("2024-03-01").cast("timestamp")),
        hosts.filter(h.like("%.example.net")).limit(1).select(F.lit("domain"), F.lit("example.net"), F.lit("remove"), F.lit("2024-04-01").cast("timestamp")),
    ]
    out = made[0]
    for m in made[1:]:
        out = out.union(m)
    return out


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    day = (F.col("page_id") * 7919 % 365).cast("int")
    captures = pages.withColumn("fetched_at", F.timestamp_add("DAY", day, F.lit("2024-01-01").cast("timestamp")))
    return url_filter.filter_urls(captures, url_list(pages))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_docs(spark, sf_dir)).withColumn("deleted", F.array_join("deleted", ","))


#: A single line of 3 words or more is boilerplate if more than six documents have it.
SHARED_BY, SHARED_WORDS = 7, 3


def op5_line_dedup_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_docs(spark, sf_dir), shared_by=SHARED_BY, shared_words=SHARED_WORDS)
    return out.withColumn("deleted", F.array_join("deleted", ","))


#: The target mixture: each source in proportion to its tokens to this power, so that small sources come more often than they occur.
TEMPER = 0.7


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), temper=TEMPER)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_docs(spark, sf_dir))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_docs(spark, sf_dir))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(_docs(spark, sf_dir))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_docs(spark, sf_dir), k=2, percent=80)


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(_docs(spark, sf_dir), tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vantage.neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=20, k=20, factor=1.0)


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _spans_sql() -> str:
    """Per rule: texts between matches and matches alternate, so running sums of lengths give the offsets."""
    sides = []
    for rank, r in enumerate(secret_scan.RULES):
        rx = r.pattern.replace("'", "''")
        sides.append(
            f"SELECT doc_id, {rank} AS rank, '{r.kind}' AS kind, {r.base} AS base, {r.least} AS least, regexp_split_to_array(t, '{rx}') AS gap, "
            f"regexp_extract_all(t, '{rx}', 0) AS hit, regexp_extract_all(t, '{rx}', {r.group}) AS part FROM d"
        )
    return " UNION ALL ".join(sides)


def _crc_sql(table: str, text: str) -> str:
    """(text, crc) of the distinct values of a column, by the table of the polynomial, which is made from its rule."""
    return f"""(WITH tbl AS (SELECT list(list_reduce([n] || range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c // 2) ELSE c // 2 END) ORDER BY n) AS tbl FROM range(256) r(n)),
        h AS (SELECT DISTINCT {text} AS w FROM {table}), x AS (SELECT w, hex(encode(CAST(w AS VARCHAR))) AS x FROM h)
        SELECT w, xor(4294967295::BIGINT, list_reduce([4294967295::BIGINT] || list_transform(range(1, length(x), 2), lambda i: CAST('0x' || x[i:i + 1] AS BIGINT)),
                      lambda c, y: xor(c // 256, tbl[CAST(xor(c % 256, y) AS INT) + 1]))) AS crc FROM x, tbl)"""


#: Levels that the SQL of the manifest goes up: 16^5 leaves in a source, 16^3 sources.
_LEVELS = 5, 3


def _manifest_sql() -> str:
    """Level by level: the runs' digests, siblings left and right of each row's path, and the folded node."""
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    part = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(part, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    steps = [
        f"k AS {_crc_sql('documents', 'doc_id')}",
        f"d AS (SELECT doc_id, coalesce('=' || source, '') AS tree, {leaf('text')} AS leaf, CASE WHEN crc % 5 = 0 THEN {leaf(lower.format('text'))} ELSE {leaf('text')} END AS used FROM documents JOIN k ON w = doc_id)",
        "a0 AS (SELECT doc_id, tree, leaf, used, '' AS proof, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS pos FROM d)",
        "n0 AS (SELECT tree, pos, leaf AS h FROM a0)",
    ]
    for i in range(_LEVELS[0] + 1 + _LEVELS[1]):
        if i == _LEVELS[0]:  # the lone nodes of the sources are the leaves of the tree over them
            steps.append(f"n{i + 1} AS (SELECT '' AS tree, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, h, tree AS of FROM n{i})")
            steps.append(f"a{i + 1} AS (SELECT doc_id, '' AS tree, leaf, used, proof, n.pos, n.h AS subroot FROM a{i} a JOIN n{i + 1} n ON n.of = a.tree)")
            continue
        sub = ", a.subroot" if i > _LEVELS[0] else ""
        steps.append(f"c{i} AS (SELECT tree, pos, h, count(*) OVER (PARTITION BY tree) AS n FROM n{i})")
        steps.append(f"n{i + 1} AS (SELECT tree, pos // 16 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM c{i} WHERE n > 1 GROUP BY ALL UNION ALL SELECT tree, pos, h FROM c{i} WHERE n = 1)")
        steps.append(
            f"s{i} AS (SELECT o.tree, o.pos, o.n, coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos < o.pos), '') AS lo, coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos > o.pos), '') AS hi "
            f"FROM c{i} o JOIN c{i} x ON x.tree = o.tree AND x.pos // 16 = o.pos // 16 GROUP BY ALL)"
        )
        steps.append(
            f"a{i + 1} AS (SELECT a.doc_id, a.tree, a.leaf, CASE WHEN n > 1 THEN sha256(lo || used || hi) ELSE used END AS used, a.proof || lo || hi AS proof, CASE WHEN n > 1 THEN a.pos // 16 ELSE a.pos END AS pos{sub} "
            f"FROM a{i} a JOIN s{i} s ON s.tree = a.tree AND s.pos = a.pos)"
        )
    last = sum(_LEVELS) + 1
    return f"WITH {', '.join(steps)} SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, used AS folded_root, used = h AS verified FROM a{last}, n{last} n"


ORACLES = {
    "op11_manifest": _manifest_sql(),
    "op9_secret_scan": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({_spans_sql()}),
        x AS (SELECT doc_id, rank, kind, base, least, unnest(range(1, len(hit) + 1)) AS i, gap, hit, part FROM m WHERE len(hit) > 0),
        y AS (SELECT doc_id, rank, kind, base, length(part[i]) >= least AS ok,
                     CAST(list_sum(list_transform(gap[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hit[1:i - 1], lambda h: length(h))), 0) AS BIGINT) AS lo, length(hit[i]) AS n FROM x),
        z AS (SELECT doc_id, rank, base, kind, lo, kind || ':' || lo || ':' || (lo + n) AS s FROM y WHERE ok),
        g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (NOT base) AS n_added,
                     string_agg(s, ',' ORDER BY lo, rank) FILTER (base) AS b, string_agg(s, ',' ORDER BY lo, rank) AS spans FROM z GROUP BY 1)
        SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256,
               coalesce(spans, '') AS spans, coalesce(n_added, 0) AS n_added FROM d LEFT JOIN g USING (doc_id)""",
    "op10_minhash": """
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w FROM documents),
        g AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w),
        c AS (SELECT g.*, len(g) AS n FROM g), e AS (SELECT doc_id, n, unnest(g) AS s FROM c),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.s = b.s AND a.doc_id < b.doc_id AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80 GROUP BY ALL),
        l AS (SELECT a, b FROM p WHERE 100 * k >= 80 * (na + nb - k)), u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id, doc_id AS m FROM c UNION SELECT u.b, r.m FROM r JOIN u ON u.a = r.doc_id WHERE r.m < u.b)
        SELECT c.doc_id, c.n AS n_shingles, q.m AS component_id, q.m = c.doc_id AS kept FROM c JOIN (SELECT doc_id, min(m) AS m FROM r GROUP BY 1) q USING (doc_id)""",
    "op5_line_dedup": """
        WITH l AS (SELECT doc_id, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS j, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        n AS (SELECT doc_id, j, ls[j + 1] AS x, row_number() OVER (PARTITION BY doc_id ORDER BY j) AS i FROM l WHERE trim(ls[j + 1]) <> ''),
        q AS (SELECT doc_id, list(x ORDER BY j) AS xs FROM n GROUP BY 1),
        s AS (SELECT doc_id, d, xs, unnest(range(1, len(xs) - d + 2)) AS i FROM q, (VALUES (1), (2), (4), (8), (16), (32), (64), (128), (256), (512)) v(d)),
        w AS (SELECT doc_id, d, i, row_number() OVER (PARTITION BY d, xs[i:i + d - 1] ORDER BY doc_id, i) > 1 AS later,
                     len(list_filter(regexp_split_to_array(xs[i], '[[:space:]]+'), lambda z: z <> '')) AS words FROM s),
        h AS (SELECT doc_id, d, i FROM w WHERE later AND (d > 1 OR words >= 50)),
        g AS (SELECT DISTINCT doc_id, i + o AS i FROM h, (VALUES (0), (1)) v(o) WHERE d <= 2 AND o < d), m AS (SELECT doc_id, max(d) AS md FROM h GROUP BY 1),
        k AS (SELECT doc_id, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g), c AS (SELECT doc_id, run, count(*) AS c FROM k GROUP BY ALL),
        t AS (SELECT doc_id, CAST(sum(c) AS BIGINT) AS nd, count(*) AS nr, max(c) AS lr FROM c GROUP BY 1), a AS (SELECT doc_id, count(*) AS nl FROM n GROUP BY 1),
        e AS (SELECT g.doc_id, string_agg(n.j, ',' ORDER BY n.j) AS js FROM g JOIN n USING (doc_id, i) GROUP BY 1)
        SELECT doc_id, coalesce(nl, 0) AS n_lines, coalesce(nd, 0) AS n_deleted, coalesce(nr, 0) AS n_runs, coalesce(lr, 0) AS longest_run, CAST(coalesce(md, 0) AS BIGINT) AS max_depth, coalesce(js, '') AS deleted
        FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN a USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN e USING (doc_id)""",
    "op4_url_filter": """
        WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host,
                          regexp_extract(url, '^https?://[^/?#]+/([^/?#]+)', 1) AS part,
                          lower(regexp_extract(url, '^https?://[^/?#]*(/[^?#]*)', 1)) AS path,
                          DATE '2024-01-01' + CAST(page_id * 7919 % 365 AS INT) AS ts FROM pages),
        h AS (SELECT DISTINCT host, part, host || '/' || part AS hp FROM p),
        d AS (SELECT *, CAST('0x' || substr(md5(host), 1, 4) AS INT) AS a, DATE '2024-01-01' + CAST('0x' || substr(md5(host), 5, 4) AS INT) % 300 AS ad,
                     CAST('0x' || substr(md5(hp), 1, 4) AS INT) AS b, DATE '2024-01-01' + CAST('0x' || substr(md5(hp), 5, 4) AS INT) % 300 AS bd FROM h),
        e AS (SELECT 'host' AS kind, host AS pattern, 'add' AS action, ad AS ts FROM d WHERE a % 5 = 0
              UNION SELECT 'host', host, 'remove', ad + 40 FROM d WHERE a % 10 = 0
              UNION SELECT 'host', host, 'add', ad + 70 FROM d WHERE a % 20 = 0
              UNION SELECT 'prefix', lower(hp), 'add', bd FROM d WHERE part <> '' AND b % 7 = 0
              UNION SELECT 'domain', 'example.net', 'add', DATE '2024-03-01' FROM d WHERE host LIKE '%.example.net'
              UNION SELECT 'domain', 'example.net', 'remove', DATE '2024-04-01' FROM d WHERE host LIKE '%.example.net'),
        v AS (SELECT *, lead(ts) OVER (PARTITION BY kind, pattern ORDER BY ts, CASE action WHEN 'remove' THEN 1 ELSE 0 END) AS til FROM e),
        hit AS (SELECT page_id, p.url, p.ts, count(DISTINCT v.kind || v.pattern) AS n, min(v.kind || ':' || v.pattern) AS fp FROM p JOIN v
                ON v.action = 'add' AND p.ts >= v.ts AND (v.til IS NULL OR p.ts < v.til) AND CASE v.kind WHEN 'host' THEN p.host = v.pattern
                   WHEN 'domain' THEN p.host = v.pattern OR ends_with(p.host, '.' || v.pattern)
                   ELSE p.host || p.path = v.pattern OR starts_with(p.host || p.path, v.pattern || '/') END GROUP BY ALL)
        SELECT p.page_id, p.host, coalesce(hit.n, 0) > 0 AS blocked, coalesce(hit.n, 0) AS n_entries, hit.fp AS first_pattern
        FROM p LEFT JOIN hit ON p.page_id = hit.page_id AND p.url = hit.url AND p.ts = hit.ts""",
    "op8_exact_dedup": """
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n""",
    "op12_neighbours": """
        WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda e: e IS NULL OR NOT isfinite(e)), true)
                   AND list_contains(list_transform(embedding, lambda e: e <> 0), true)),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce([0.0::DOUBLE] || list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i]), lambda a, b: a + b) AS score
              FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    # crc32 by the table of its polynomial, made from the rule, over the bytes of each distinct word.
    "op13_resample": r"""
        WITH tbl AS (SELECT list(list_reduce([n] || range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c // 2) ELSE c // 2 END) ORDER BY n) AS tbl FROM range(256) r(n)),
        d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        m AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
        e AS (SELECT doc_id, unnest(ws) AS w FROM d), v AS (SELECT w, count(*) AS s FROM e GROUP BY 1), u AS (SELECT w, count(*) AS t FROM m GROUP BY 1),
        h AS (SELECT w, coalesce(s, 0) AS s, coalesce(t, 0) AS t, hex(encode(w)) AS x FROM v FULL JOIN u USING (w)),
        b AS (SELECT w, s, t, xor(4294967295::BIGINT, list_reduce([4294967295::BIGINT] || list_transform(range(1, length(x), 2), lambda i: CAST('0x' || x[i:i + 1] AS BIGINT)),
                     lambda c, y: xor(c // 256, tbl[CAST(xor(c % 256, y) AS INT) + 1]))) % 10000 AS b FROM h, tbl),
        c AS (SELECT b, sum(s) AS s, sum(t) AS t FROM b GROUP BY 1), n AS (SELECT sum(s) AS ss, sum(t) AS tt FROM c),
        g AS (SELECT b, CAST(floor(1000 * ln((t + 1)::DOUBLE * (ss + 10000)::DOUBLE / ((s + 1)::DOUBLE * (tt + 10000)::DOUBLE))) AS BIGINT) AS gain FROM c, n),
        k AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM e JOIN b USING (w) JOIN g USING (b) GROUP BY 1),
        z AS (SELECT d.doc_id, len(ws) AS n_features, coalesce(weight, 0) AS weight,
                     coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5)::DOUBLE / 4294967296.0::DOUBLE))) AS BIGINT) AS score
              FROM d LEFT JOIN k USING (doc_id)),
        r AS (SELECT *, n_features >= 20 AS ok, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS i, count(*) FILTER (n_features >= 20) OVER () AS n FROM z)
        SELECT doc_id, n_features, weight, score, CASE WHEN ok AND i <= n * 10 // 100 THEN i END AS rank FROM r""",
}

#: The same with the number of documents that have a line.
ORACLES["op5_line_dedup_shared"] = (
    ORACLES["op5_line_dedup"]
    .replace("> 1 AS later,", "> 1 AS later, count(DISTINCT doc_id) OVER (PARTITION BY d, xs[i:i + d - 1]) AS docs,")
    .replace("(d > 1 OR words >= 50)", f"(d > 1 OR words >= 50 OR docs >= {SHARED_BY} AND words >= {SHARED_WORDS})")
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
