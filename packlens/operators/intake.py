"""Intake: URL lists, platforms, fetch outcomes, URL safety and uploads."""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packlens.functions.text import strip
from packlens.functions.vocab import PLATFORM_DOMAINS

#: Address blocks that are not public.
RESERVED = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
)
KINDS = ("png", "jpg", "jpeg", "webp", "pdf")


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def platform(url: Column) -> Column:
    """By the host: equal to a known domain or below it, never a part of a name."""
    h = host(url)
    out = F.when(F.lit(False), F.lit(""))
    for name, domain in PLATFORM_DOMAINS:
        out = out.when((h == domain) | h.endswith("." + domain), F.lit(name))
    return out.otherwise(F.lit("generic"))


def fetch_status(robots_allowed: Column, code: Column, error: Column) -> Column:
    return (
        F.when(~robots_allowed, "BLOCKED_BY_ROBOTS")
        .when(robots_allowed.isNull(), "FAILED")
        .when(code.isin(401, 403, 429), "ACCESS_DENIED")
        .when(code >= 400, "FAILED")
        .when(error.contains("Timeout"), "TIMEOUT")
        .when(error.isNotNull(), "FAILED")
        .otherwise("SUCCESS")
    )


def ip_number(ip: Column) -> Column:
    """IPv4 as a number; null for anything else."""
    p = F.split(ip, r"\.")
    part = lambda i: F.get(p, F.lit(i)).try_cast("bigint")
    ok = ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & (F.greatest(*[part(i) for i in range(4)]) <= 255)
    return F.when(ok, ((part(0) * 256 + part(1)) * 256 + part(2)) * 256 + part(3))


#: IPv6 blocks that are no public addresses; outside 2000::/3 none is one.
RESERVED_6 = ("2001::/23", "2001:db8::/32", "2002::/16", "3fff::/20")
#: Blocks of the first of these that are public all the same.
PUBLIC_6 = ("2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")


def ip6_groups(ip: Column) -> Column:
    """The eight 16-bit groups of an IPv6 address; null for anything else. A zone is ignored, and a dotted tail counts as
    two groups."""
    bare = F.regexp_replace(F.lower(ip), "%.*$", "")
    dotted = ip_number(F.regexp_extract(bare, r"([^:]*)$", 1))
    hexed = F.when(
        dotted.isNotNull(), F.concat(F.regexp_extract(bare, r"^(.*:)[^:]*$", 1), F.lower(F.hex(F.shiftright(dotted, 16))), F.lit(":"), F.lower(F.hex(dotted.bitwiseAND(65535))))
    ).otherwise(bare)
    halves = F.split(hexed, "::", -1)
    groups = lambda i: F.filter(F.split(F.coalesce(F.get(halves, F.lit(i)), F.lit("")), ":"), lambda g: g != "")
    missing = 8 - F.size(groups(0)) - F.size(groups(1))
    every = F.concat(groups(0), F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), groups(1))
    ok = hexed.rlike("^[0-9a-f:]*:[0-9a-f:]*$") & ~hexed.rlike("^:[^:]|[^:]:$|:::") & F.when(F.size(halves) == 2, missing >= 1).otherwise((F.size(halves) == 1) & (missing == 0))
    ok = ok & F.forall(every, lambda g: F.length(g) <= 4)
    return F.when(ok, F.transform(every, lambda g: F.conv(g, 16, 10).cast("bigint")))


def _in_block_6(groups: Column, block: str) -> Column:
    net, bits = int(ipaddress.ip_network(block).network_address), int(block.split("/")[1])
    same = F.lit(True)
    for i in range(-(-bits // 16)):
        keep = 16 - max(0, 16 * (i + 1) - bits)
        mask = (0xFFFF << (16 - keep)) & 0xFFFF
        same = same & (F.get(groups, F.lit(i)).bitwiseAND(mask) == (net >> (112 - 16 * i) & mask))
    return same


def unsafe_ip6(ip: Column) -> Column:
    """Whether an IPv6 address is private, reserved, local, multicast or unspecified; null for anything else. An
    IPv4-mapped address lies in a reserved block too."""
    g = ip6_groups(ip)
    some = lambda blocks: reduce(lambda a, b: a | b, [_in_block_6(g, b) for b in blocks])
    return F.when(g.isNotNull(), ~_in_block_6(g, "2000::/3") | (some(RESERVED_6) & ~some(PUBLIC_6)))


def reserved_blocks(spark: SparkSession) -> DataFrame:
    rows = []
    for block in RESERVED:
        net, bits = block.split("/")
        a, b, c, d = map(int, net.split("."))
        lo = ((a * 256 + b) * 256 + c) * 256 + d
        rows.append((block, lo, lo + 2 ** (32 - int(bits)) - 1))
    return spark.createDataFrame(rows, "block string, lo bigint, hi bigint")


def in_reserved(ips: DataFrame, ip_col: str) -> DataFrame:
    """Rows whose address lies in a reserved block: a range join with a broadcast table of 14 blocks."""
    n = ips.withColumn("ip_num", ip_number(F.col(ip_col)))
    return n.join(F.broadcast(reserved_blocks(ips.sparkSession)), F.col("ip_num").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def safe_scheme_and_host(url: Column) -> Column:
    scheme, h = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), host(url)
    return F.coalesce(scheme.isin("http", "https") & (h != "") & ~h.isin("localhost", "localhost.localdomain", "ip6-localhost") & ~h.endswith(".local"), F.lit(False))


def safe_urls(urls: DataFrame, answers: DataFrame, url_col: str = "url") -> DataFrame:
    """URLs whose scheme and host are fine and whose host has no answer (host, ip) in a reserved block or of
    unknown form."""
    strange = ip_number(F.col("ip")).isNull() & F.coalesce(unsafe_ip6(F.col("ip")), F.lit(True))
    bad = in_reserved(answers, "ip").select("host").union(answers.filter(strange).select("host")).distinct()
    u = urls.filter(safe_scheme_and_host(F.col(url_col))).withColumn("host", host(F.col(url_col)))
    return u.join(answers.select("host").distinct(), "host", "left_semi").join(bad, "host", "left_anti")


def url_positions(batches: DataFrame) -> DataFrame:
    """(batch_id, urls array) as one row per URL with its position."""
    return batches.select("batch_id", F.posexplode("urls").alias("pos", "url"))


def accept_urls(urls: DataFrame, limit: int = 50) -> DataFrame:
    """(batch_id, pos, url) with decision: accepted, too short, duplicate, or over limit. The first `limit`
    distinct URLs of a batch are accepted; a repeat of one of those is a duplicate, any later URL is over
    the limit. Only the accepted URLs are ranked: every task keeps its first `limit` of a batch and no more of them meet
    in one, so a batch of any length is spread."""
    u = urls.withColumn("url", strip(F.coalesce("url", F.lit(""))))
    long_ = F.length("url") >= 8
    first = u.filter(long_).groupBy("batch_id", "url").agg(F.min("pos").alias("first_pos"))
    nth = F.row_number().over(Window.partitionBy("batch_id").orderBy("first_pos"))
    some = first.withColumn("nth", nth).filter(F.col("nth") <= limit).drop("nth")
    j = u.join(some, ["batch_id", "url"], "left")
    return j.select(
        "batch_id", "pos", "url",
        F.when(~long_, "too short").when(F.col("first_pos").isNull(), "over limit").when(F.col("pos") > F.col("first_pos"), "duplicate").otherwise("accepted").alias("decision"),
    )


def upload_ok(path: Column, length: Column, content_type: Column, most: int = 15 * 1024 * 1024) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    kind = F.regexp_extract(F.lower(F.coalesce(content_type, F.lit(""))), r"/([a-z0-9]+)$", 1)
    return F.when(ext == "", kind).otherwise(ext).isin(*KINDS) & (length <= most)


def valid_rule_key(c: Column) -> Column:
    return F.coalesce(c.rlike("^[A-Z0-9]+(-[A-Z0-9]+)*$"), F.lit(False))
