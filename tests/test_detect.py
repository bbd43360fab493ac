"""The feed-to-alert plan: rules once per answer, repeats on narrow rows, answers shared by the counts."""

import datetime as dt

from pyspark.sql import functions as F

from domsift.functions.dns import dns_status, is_success
from domsift.operators.alerts import ENRICHMENT_TYPE, dns_snapshot
from domsift.operators.dedup import suppress_repeats
from domsift.plans import queries
from domsift.plans.detect import detect

T0 = dt.datetime(2024, 1, 1)
FEED = "event_id BIGINT, seen_at TIMESTAMP, domain STRING, user_id BIGINT, event_type STRING, value DOUBLE"
ANSWERS = f"domain STRING, a ARRAY<STRING>, aaaa ARRAY<STRING>, ns ARRAY<STRING>, enrichment {ENRICHMENT_TYPE}"
OBS = "event_id INT, domain STRING, observed_at TIMESTAMP, ns_error STRING, a_error STRING, aaaa_error STRING, ns ARRAY<STRING>, a ARRAY<STRING>, aaaa ARRAY<STRING>"
#: blog is named by a name rule, low by its ASN; lost has no enrichment, gone no answer, None no name
SEEN = ["blog.a.com", "low.b.net", "plain.c.org", "lost.blog.com", "gone.blog.com", None]


def given(spark):
    feed = [(i, T0 + dt.timedelta(hours=i), SEEN[i % len(SEEN)], 1, "view", 1.0) for i in range(60)]
    known = [
        ("blog.a.com", ["9.9.9.9"], [], ["ns"], [("9.9.9.9", 99, "n", "DE")]),
        ("low.b.net", ["0.0.0.1"], None, None, [("0.0.0.1", 3, "n", "DE")]),
        ("plain.c.org", [], [], [], None),
        ("lost.blog.com", ["1.1.1.1"], [], [], None),
        ("unseen.com", ["1.1.1.1"], [], [], []),
        (None, ["1.1.1.1"], [], [], []),
    ]
    return spark.createDataFrame(feed, FEED).repartition(3), spark.createDataFrame(known, ANSWERS)


def test_rules_are_asked_once_per_answer(spark):
    feed, known = given(spark)
    out = detect(feed, known, queries.enriched_rules(), None, ttl_seconds=None, apply_ignore=False)
    assert out.columns == [
        "domain", "event_id", "user_id", "event_type", "value", "timestamp", "resolved_after_nxdomain", "dns", "enrichment", "source_tag", "base_domain",
    ]
    got = {r.event_id: (r.domain, r.source_tag, r.timestamp) for r in out.collect()}
    tags = {"blog.a.com": ["blog", "com-elsewhere"], "low.b.net": ["low-asn"]}
    assert got == {i: (SEEN[i % 6], tags[SEEN[i % 6]], T0 + dt.timedelta(hours=i)) for i in range(60) if i % 6 < 2}
    assert "exists(" not in out._jdf.queryExecution().optimizedPlan().toString()  # no ASN rule on the feed's rows


def test_repeats_are_sorted_as_narrow_rows(spark):
    feed, known = given(spark)
    out = detect(feed, known, queries.enriched_rules(), None, ttl_seconds=86400, apply_ignore=False)
    assert out.columns[-3:] == ["source_tag", "base_domain", "dedup_key"]
    assert {r.event_id for r in out.select("event_id").collect()} == {0, 1, 24, 25, 48, 49}
    wide = spark.createDataFrame([(i, "k", T0, "x" * 100) for i in (3, 1, 1, 2)], "id INT, key STRING, ts TIMESTAMP, wide STRING")
    flagged = suppress_repeats(wide, "key", "ts", 10, order="id")
    assert sorted((r.id, r.passed) for r in flagged.collect()) in ([(1, False), (1, True), (2, False), (3, False)],)
    assert "Window" not in flagged._jdf.queryExecution().executedPlan().toString()


def test_counts_share_one_snapshot(spark, monkeypatch):
    feed, known = given(spark)
    made = []
    monkeypatch.setattr(queries.tables, "feed", lambda spark, d: feed)
    monkeypatch.setattr(queries, "_enriched_snapshot", lambda spark, d: made.append(d) or known)
    counts = {r.stage: r.n for r in queries.q_pipeline_counts(spark, "x").collect()}
    assert counts == {"ingested": 60, "kept": 60, "alerts": 20, "passed": 6} and made == ["x"]


def test_snapshot_is_the_latest_answer(spark):
    ok = [["1.1.1.1"], []]
    rows = [
        (1, "a", T0, None, None, None, None, *ok), (2, "a", T0, None, None, None, None, ["2.2.2.2"], None), (9, "a", T0, "NXDOMAIN", None, None, None, *ok),
        (3, "b", None, None, None, None, None, *ok), (4, "b", None, None, "SERVFAIL", None, None, None, ["::1"]), (5, None, T0, None, None, None, None, *ok),
        (6, "c", T0, None, "timeout", None, None, [], None), (7, "d", None, None, None, None, None, *ok), (8, "d", T0, None, None, None, None, *ok),
    ]
    dns = spark.createDataFrame(rows, OBS)
    assert {(r.domain, r.event_id) for r in dns_snapshot(dns, order="event_id").collect()} == {("a", 2), ("b", 4), (None, 5), ("d", 8)}
    assert dns.where(is_success() != (dns_status() == F.lit("success"))).count() == 0
