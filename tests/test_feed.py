import pytest
from pyspark.sql import functions as F

from domsift.functions.text import rfc3339
from domsift.sources.rules import pattern_lines
from domsift.operators.feed import ignored_names, sample_feed, sample_repeatable
from domsift.sources.feed import parse_messages


def test_parse_messages_fixture(spark):
    msgs = [
        ('{"data": ["example.com", "www.example.com", "*.example.com"]}', 3),
        ('{"data": []}', 0),
        ('{"invalid": "json structure', 0),
        ('{"message_type": "certificate_update"}', 0),
        ('{"data": ["a.com", 1]}', 0),  # a non-string element drops the whole message
        ('{"data": {"x": 1}}', 0),
    ]
    df = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(msgs)], "id INT, value STRING")
    got = {r["id"]: r["n"] for r in parse_messages(df).groupBy("id").agg(F.count(F.lit(1)).alias("n")).collect()}
    for i, (_, n) in enumerate(msgs):
        assert got.get(i, 0) == n
    names = [r.domain for r in parse_messages(df).where("id = 0").collect()]
    assert sorted(names) == sorted(["example.com", "www.example.com", "*.example.com"])  # no normalisation


def test_parse_full_format(spark):
    df = spark.createDataFrame([('{"data": {"leaf_cert": {"all_domains": ["a.com", "b.com"]}}}',)], "value STRING")
    assert sorted(r.domain for r in parse_messages(df, fmt="full").collect()) == ["a.com", "b.com"]


def test_sampling_rates(spark):
    df = spark.range(10_000).withColumnRenamed("id", "event_id")
    half = sample_feed(df, 0.5, seed=7).count()
    assert 4_500 <= half <= 5_500
    assert sample_feed(df, 1.0).count() == 10_000
    assert sample_feed(df, 0.0).count() == 0
    with pytest.raises(ValueError):
        sample_feed(df, 1.5)
    a = sample_repeatable(df, "event_id", 0.25)
    assert a.count() == sample_repeatable(df, "event_id", 0.25).count() == 2_500


def test_exact_name_lists(spark):
    df = spark.createDataFrame([("a.com",), ("b.com",), ("c.com",)], "domain STRING")
    deny = spark.createDataFrame([("b.com",)], "name STRING")
    assert sorted(r.domain for r in ignored_names(df, deny).collect()) == ["a.com", "c.com"]
    assert [r.domain for r in ignored_names(df, deny, allow=True).collect()] == ["b.com"]


def test_sampling_small_rates_and_large_ids(spark):
    df = spark.range(1_000_000)
    assert sample_repeatable(df, "id", 0.0001).count() == 100
    assert sample_repeatable(df, "id", 0.0015).count() == 1500
    sample_repeatable(spark.range(10).selectExpr("xxhash64(id) AS id"), "id", 0.5).count()


def test_rule_lines_are_trimmed_of_all_white_space(spark):
    df = spark.createDataFrame([("f", "evil\\.test\r\n\t#note\n\r\n \tpay$\t\r\n")], "name STRING, text STRING")
    assert [(r.line_no, r.pattern) for r in pattern_lines(df, "name", "text").orderBy("line_no").collect()] == [(1, "evil\\.test"), (4, "pay$")]


def test_time_text_is_utc_in_any_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/Los_Angeles"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = spark.sql("SELECT timestamp_seconds(1704067200) AS t").select(rfc3339("t").alias("x")).first().x
            assert got == "2024-01-01T00:00:00+00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
