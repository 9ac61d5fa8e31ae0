import ipaddress
from datetime import date, datetime

from packlens.operators import intake, report, versioning
from pyspark.sql import functions as F

T = lambda d: datetime(2024, 1, d)


def test_platform_is_the_host_not_a_part_of_a_name(spark):
    urls = ["https://www.amazon.in/x", "https://amazon.in", "https://notamazon.in/", "https://evil.org/?next=blinkit.com", "https://blinkit.com.evil.org", "HTTPS://BLINKIT.COM/p", "nonsense", None]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string")
    got = [r.p for r in df.select("i", intake.platform(F.col("u")).alias("p")).orderBy("i").collect()]
    assert got == ["amazon", "amazon", "generic", "generic", "generic", "blinkit", "generic", "generic"]


def test_unsafe_urls(spark):
    hosts = {"ok.org": ["93.184.216.34"], "mixed.org": ["93.184.216.34", "10.0.0.1"], "link.org": ["169.254.1.1"], "loop.org": ["127.0.0.1"], "odd.org": ["::1"]}
    urls = [f"http://{h}/" for h in hosts] + ["ftp://ok.org/", "http://printer.local/", "http://localhost/", "http:///x", None]
    answers = spark.createDataFrame([(h, ip) for h, ips in hosts.items() for ip in ips], "host string, ip string")
    got = intake.safe_urls(spark.createDataFrame([(u,) for u in urls], "url string"), answers)
    assert [r.url for r in got.collect()] == ["http://ok.org/"]


def test_url_intake(spark):
    rows = [("b", 0, "http://a.org/1"), ("b", 1, ""), ("b", 2, " http://a.org/1 "), ("b", 3, "http://a.org/2"), ("b", 4, "http://a.org/3"), ("b", 5, "http://a.org/3"), ("b", 6, None)]
    got = {r.pos: r.decision for r in intake.accept_urls(spark.createDataFrame(rows, "batch_id string, pos int, url string"), limit=2).collect()}
    assert got == {0: "accepted", 1: "too short", 2: "duplicate", 3: "accepted", 4: "over limit", 5: "over limit", 6: "too short"}


def test_fetch_outcomes(spark):
    rows = [(False, None, None), (None, None, None), (True, 403, None), (True, 404, None), (True, None, "Timeout 30000ms"), (True, None, "reset"), (True, 200, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, r boolean, c int, e string")
    got = [r.s for r in df.select("i", intake.fetch_status(F.col("r"), F.col("c"), F.col("e")).alias("s")).orderBy("i").collect()]
    assert got == ["BLOCKED_BY_ROBOTS", "FAILED", "ACCESS_DENIED", "FAILED", "TIMEOUT", "FAILED", "SUCCESS"]


def test_rule_keys(spark):
    keys = ["LM-R1", "A", "a-b", "A--B", "A-", "<b>", "", None]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k string")
    assert [r.v for r in df.select("i", intake.valid_rule_key(F.col("k")).alias("v")).orderBy("i").collect()] == [True, True, False, False, False, False, False, False]


RULES = "rule_key string, title string, validation_type string, severity string, requirement string, validator_config string"
STORE = "rule_key string, active boolean, version_number int, is_current boolean, title string, validation_type string, severity string, requirement string, validator_config string, content_hash string"


def test_rule_versions(spark):
    rule = lambda k, t: (k, t, "PRESENCE_CHECK", "MAJOR", None, None)
    load = lambda *r: versioning.with_hash(spark.createDataFrame(list(r), RULES))
    actions = lambda s, i: {r.rule_key: r.action for r in versioning.plan_load(s, i).collect()}
    fix = lambda df: spark.createDataFrame(df.collect(), df.schema)
    one = load(rule("A", "x"), rule("B", "y"))
    store = fix(versioning.apply_load(spark.createDataFrame([], STORE), one))
    assert actions(store, one) == {"A": "unchanged", "B": "unchanged"}
    again = fix(versioning.apply_load(store, one))
    assert sorted(again.collect()) == sorted(store.collect())
    two = load(rule("A", "new"))
    assert actions(store, two) == {"A": "new_version", "B": "deactivated"}
    store = fix(versioning.apply_load(store, two))
    assert {(r.rule_key, r.version_number, r.is_current, r.active) for r in store.collect()} == {("A", 1, False, True), ("A", 2, True, True), ("B", 1, True, False)}
    back = load(rule("A", "new"), rule("B", "y"))
    assert actions(store, back) == {"A": "unchanged", "B": "reactivated"}
    store = fix(versioning.apply_load(store, back))
    assert store.count() == 3 and versioning.current_rules(store).count() == 2


def test_triage_puts_the_worst_first(spark):
    items = spark.createDataFrame(
        [("b", "pass", "PASS", 0, 0, 0.0), ("b", "none", None, 0, 0, 0.0), ("b", "pnc1", "POTENTIAL_NON_COMPLIANCE", 3, 0, 0.9), ("b", "pnc2", "POTENTIAL_NON_COMPLIANCE", 1, 1, 0.5), ("b", "utv", "UNABLE_TO_VERIFY", 0, 0, 0.0),
         ("b", "nmr", "NEEDS_MANUAL_REVIEW", 0, 0, 0.0)],
        "batch_id string, inspection_id string, overall_status string, n_violations long, n_critical long, max_confidence double",
    )
    assert [r.inspection_id for r in report.triage_queue(items).orderBy("place").collect()] == ["pnc2", "pnc1", "nmr", "utv", "pass", "none"]


def test_sweep_is_idempotent(spark):
    ins = spark.createDataFrame([("a", "IN_PROGRESS"), ("b", "CREATED"), ("c", "COMPLETED")], "inspection_id string, run_status string")
    batches = spark.createDataFrame([("x", "IN_PROGRESS"), ("y", "CREATED")], "batch_id string, status string")
    ins2, batches2, events = report.sweep_stale(ins, batches, "2024-01-02")
    assert {r.inspection_id: r.run_status for r in ins2.collect()} == {"a": "FAILED", "b": "CREATED", "c": "COMPLETED"} and events.count() == 1
    assert {r.batch_id: r.status for r in batches2.collect()} == {"x": "COMPLETED", "y": "CREATED"}
    assert report.sweep_stale(ins2, batches2, "2024-01-03")[2].count() == 0


def test_reviews(spark):
    checks = spark.createDataFrame([(1, "i", "POTENTIAL_NON_COMPLIANCE"), (2, "i", "POTENTIAL_NON_COMPLIANCE"), (3, "j", "PASS")], "check_id int, inspection_id string, status string")
    reviews = spark.createDataFrame([(1, "i", "PASS", T(1)), (1, "i", "NEEDS_MANUAL_REVIEW", T(2)), (2, "other", "PASS", T(1))], "check_id int, inspection_id string, final_status string, created_at timestamp")
    assert {r.check_id: r.final_status for r in report.reviewed_status(checks, reviews).collect()} == {1: "NEEDS_MANUAL_REVIEW", 2: "POTENTIAL_NON_COMPLIANCE", 3: "PASS"}
    assert [r.check_id for r in report.review_backlog(checks, reviews.filter("check_id = 1")).collect()] == [2]


def test_every_content_field_makes_a_version(spark):
    kinds = {"validator_config": "string", "gating_only": "boolean", "effective_from": "date"} | {c: "array<string>" for c in ("applicable_categories", "excluded_categories")}
    schema = "rule_key string, " + ", ".join(f"{c} {kinds.get(c, 'string')}" for c in versioning.CONTENT)
    new = {"validator_config": '{"min": 1}', "gating_only": True, "effective_from": date(2024, 1, 1)} | {c: ["food"] for c in ("applicable_categories", "excluded_categories")}
    hashes = lambda rows: {r.rule_key: r.content_hash for r in versioning.with_hash(spark.createDataFrame(rows, schema)).collect()}
    rows = [(c, *[new.get(d, "y") if d == c else None for d in versioning.CONTENT]) for c in versioning.CONTENT]
    assert len(rows) == 17 and len(set(hashes([*rows, ("none", *[None] * 17)]).values())) == 18
    empty = {"validator_config": "{}", "gating_only": False, "applicable_categories": [], "excluded_categories": []}
    assert len(set(hashes([("a", *[None] * 17), ("b", *[empty.get(c) for c in versioning.CONTENT])]).values())) == 1
    orders = [(k, *[v if c == "validator_config" else None for c in versioning.CONTENT]) for k, v in (("a", '{"x": 1, "y": [2]}'), ("b", '{"y":[2],"x":1}'))]
    assert len(set(hashes(orders).values())) == 1


def test_ipv6_answers(spark):
    texts = ["2606:4700::1111", "2001:4860:4860::8888", "::1", "::", "fe80::1%eth0", "fc00::5", "fd12:3456::1", "ff02::1", "2001:db8::1", "2001:3::9", "2001:20::1", "2001::1", "2002:a00:1::",
             "::ffff:10.0.0.1", "64:ff9b::1.2.3.4", "3fff::1", "2a00:1450:4001:82a::200e", "1:2:3:4:5:6:7", "1::2::3", ":1:2", "12345::", "host", "1.2.3.4", "2400:cb00:2048:1:0:0:6814:55", "100::1"]
    rows = spark.createDataFrame([(t,) for t in texts], "ip string").select("ip", intake.unsafe_ip6(F.col("ip")).alias("bad")).collect()

    def want(t):
        try:
            a = ipaddress.ip_address(t.split("%")[0])
        except ValueError:
            return None
        return None if a.version == 4 else a.is_private or a.is_loopback or a.is_link_local or a.is_reserved or a.is_multicast or a.is_unspecified

    got = {r.ip: r.bad for r in rows}
    newer = ("64:ff9b::1.2.3.4", "3fff::1")  # not known to every version of the module
    assert all(got[t] for t in newer) and {t: got[t] for t in texts if t not in newer} == {t: want(t) for t in texts if t not in newer}
    urls = spark.createDataFrame([("https://a.example/x",), ("https://b.example/x",)], "url string")
    answers = spark.createDataFrame([("a.example", "2606:4700::1111"), ("a.example", "93.184.216.34"), ("b.example", "fe80::1")], "host string, ip string")
    assert [r.host for r in intake.safe_urls(urls, answers).collect()] == ["a.example"]
