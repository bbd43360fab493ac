"""Looking along a key in time buckets, exact suppression and answers within a horizon, against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from test_streaming import _run, _stream, at

from domsift.operators import scan
from domsift.operators.alerts import attach_dns_within
from domsift.operators.dedup import folded_times, passing_times, suppress_repeats
from domsift.operators.dns import failure_rate
from domsift.streaming import ops

ROWS = "key STRING, us BIGINT, tie INT, value STRING"


def rows(seed, n=400):
    draw = random.Random(seed)
    made = [(draw.choice(["a", "a", "a", "b", None]), draw.choice([None, draw.randrange(60), draw.randrange(5000)]), i, draw.choice([None, "x", "y", "z"])) for i in range(n)]
    return made + [("lone", 7, n, "x"), ("silent", 7, n + 1, None), ("silent", 9000, n + 2, None)]


@pytest.mark.parametrize("ahead", [False, True])
@pytest.mark.parametrize("bucket", [1e-6, 0.0001, 0.0013, 100.0])
def test_look(spark, ahead, bucket):
    given = rows(1)
    df = spark.createDataFrame(given, ROWS).repartition(7)
    got = {r.tie: r.met for r in scan.look(df, ["key"], F.col("us"), F.col("value"), "met", ["tie"], ahead, bucket).collect()}
    place = lambda r: (r[1] is not None, r[1] or 0, r[2])
    for row in given:
        if ahead:
            near = [r for r in given if r[0] == row[0] and place(r) > place(row) and r[3] is not None]
            want = min(near, key=place)[3] if near else None
        else:
            near = [r for r in given if r[0] == row[0] and place(r) < place(row) and r[3] is not None]
            want = max(near, key=place)[3] if near else None
        assert got[row[2]] == want
    assert scan.look(df.limit(0), ["key"], F.col("us"), F.col("value"), "met").columns == [*df.columns, "met"]


def test_trailing_sums(spark):
    given = [r for r in rows(2) if r[1] is not None]
    df = spark.createDataFrame([(k, at(us / 1000), tie, v == "x") for k, us, tie, v in given], "key STRING, ts TIMESTAMP, tie INT, bad BOOLEAN")
    got = {r.tie: (r.checks, r.failures) for r in failure_rate(df, "key", "ts", "bad", window_seconds=1).collect()}
    for key, us, tie, _ in given:
        near = [r for r in given if r[0] == key and us - 1000 <= r[1] <= us]
        assert got[tie] == (len(near), sum(r[3] == "x" for r in near))


def test_trailing_sums_run_once_over_a_bucket(spark):
    """A frame that slides is summed anew at each row; null times and values keep their sums."""
    given = [(k, us, tie, None if v == "z" else tie) for k, us, tie, v in rows(6)]
    df = spark.createDataFrame(given, "key STRING, us BIGINT, tie INT, worth BIGINT").repartition(3)
    out = scan.trailing(df, ["key"], F.col("us"), 0.001, {"n": F.lit(1).cast("bigint"), "total": F.col("worth")})
    assert out.columns == [*df.columns, "n", "total"]
    assert "RangeFrame, -1000" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.tie: (r.n, r.total) for r in out.collect()}
    for key, us, tie, _ in given:
        near = [r for r in given if r[0] == key and (r[1] is None if us is None else r[1] is not None and us - 1000 <= r[1] <= us)]
        worth = [r[3] for r in near if r[3] is not None]
        assert got[tie] == (len(near), sum(worth) if worth else None)


def greedy(given, ttl):
    last, passed = {}, set()
    for key, t in sorted(given):
        if key not in last or t >= last[key] + ttl:
            last[key] = t
            passed.add((key, t))
    return passed


@pytest.mark.parametrize("ttl", [1, 7, 50, 4000])
def test_passing_times(spark, ttl):
    draw = random.Random(ttl)
    given = [(f"={draw.randrange(3)}", draw.randrange(draw.choice([300, 20_000]))) for _ in range(900)]
    given += [("=steady", 3 * i) for i in range(400)]  # one long chain
    df = spark.createDataFrame(given, "_k STRING, _t BIGINT").repartition(5)
    assert {tuple(r) for r in passing_times(df, ttl).collect()} == greedy(given, ttl)
    assert {tuple(r) for r in folded_times(df, ttl).collect()} == greedy(given, ttl)


@pytest.mark.parametrize("fold_times", [4096, 50, 0])
def test_suppression_of_ties_nulls_and_hot_keys(spark, fold_times):
    given = [(i, "hot" if i % 3 else None, at(i // 2)) for i in range(200)] + [(900, "x", None), (901, "x", None), (902, "x", at(0)), (903, "x", at(0))]
    df = spark.createDataFrame(given, "id INT, key STRING, ts TIMESTAMP").withColumn("_n", F.lit("mine"))
    out = suppress_repeats(df, "key", "ts", 10, order="id", fold_times=fold_times)
    assert out.columns == ["id", "key", "ts", "_n", "passed"]
    got = {r.id for r in out.collect() if r.passed}
    want, last = {900, 901}, {}
    for i, key, ts in sorted((r for r in given if r[2]), key=lambda r: (r[2], r[0])):
        if key not in last or ts >= last[key] + dt.timedelta(seconds=10):
            last[key] = ts
            want.add(i)
    assert got == want
    assert suppress_repeats(df, "key", "ts", 0).where("passed").count() == len(given)
    assert suppress_repeats(df.limit(0), "key", "ts", 10).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan


FEED = "id INT, domain STRING, seen_at TIMESTAMP"
DNS = "answer_id INT, domain STRING, observed_at TIMESTAMP, ns_error STRING, a_error STRING, aaaa_error STRING, ns ARRAY<STRING>, a ARRAY<STRING>, aaaa ARRAY<STRING>"


def answer(i, name, seconds, error=None):
    return (i, name, at(seconds), error, None, None, [], [] if error else [f"192.0.2.{i}"], [])


NAMES = [[(1, "a.com", at(0)), (2, "b.com", at(5)), (3, "c.com", at(10))], [(4, "a.com", at(40)), (5, "d.com", at(45)), (6, None, at(46))], [(7, "late.com", at(100))], [(8, "end.com", at(4000))]]
ANSWERS = [
    [answer(1, "b.com", 2), answer(2, "a.com", 12), answer(3, "a.com", 12)],  # b.com: from before it was seen
    [answer(4, "b.com", 30, "SERVFAIL"), answer(5, "b.com", 65), answer(6, "a.com", 41), answer(7, "c.com", 80)],  # b.com at the horizon, c.com beyond
    [answer(8, "late.com", 130), answer(9, "d.com", 104)],
    [answer(10, "other.com", 4000)],
]
MET = {(1, 2), (2, 5), (4, 6), (5, 9), (7, 8)}


def test_answers_within_a_horizon(spark):
    feed, dns = spark.createDataFrame(sum(NAMES, []), FEED), spark.createDataFrame(sum(ANSWERS, []), DNS)
    for bucket in (1, 30, 86_400):
        got = attach_dns_within(feed, dns, 60, order="answer_id", bucket_seconds=bucket)
        assert {(r.id, r.answer_id) for r in got.collect()} == MET
    assert got.columns == ["id", "domain", "seen_at", "answer_id", "observed_at", "ns_error", "a_error", "aaaa_error", "ns", "a", "aaaa"]
    with pytest.raises(ValueError, match="id"):
        attach_dns_within(feed, dns.withColumnRenamed("answer_id", "id"), 60)


def test_streamed_answers_equal_the_batch(spark):
    live = ops.attach_dns_stream(_stream(spark, FEED, *NAMES), _stream(spark, DNS, *ANSWERS), 60, order="answer_id", watermark="20 seconds")
    assert {(r.id, r.answer_id) for r in _run(spark, live, "answers_met").collect()} == MET


def test_answers_that_come_much_earlier_or_later_than_their_names(spark):
    """An answer's batch may come before its name's, or batches after it, within the watermark."""
    names = [[], [], sum(NAMES[:3], []), NAMES[3]]
    answers = [sum(ANSWERS[:3], []), [], [], ANSWERS[3]]
    live = ops.attach_dns_stream(_stream(spark, FEED, *names), _stream(spark, DNS, *answers), 60, order="answer_id", watermark="10 minutes")
    assert {(r.id, r.answer_id) for r in _run(spark, live, "answers_early").collect()} == MET
