import datetime as dt
import os
import random
import tempfile

from pyspark.sql import functions as F

from domsift.functions.text import format_plain
from domsift.operators.dedup import suppress_repeats
from domsift.operators.dns import retry_outcome
from domsift.operators.sketch import merge_sketches, quantile_sketch, sketch_quantiles
from domsift.sinks.writers import epoch_sink, fan_out, ledger_counts, stream_alerts
from domsift.streaming import ops

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)
ALERT = ("id INT, channel STRING, timestamp TIMESTAMP, domain STRING, base_domain STRING, source_tag ARRAY<STRING>, "
         "resolved_after_nxdomain BOOLEAN, dns STRUCT<a_records: ARRAY<STRING>, aaaa_records: ARRAY<STRING>, ns_records: ARRAY<STRING>>, "
         "enrichment ARRAY<STRUCT<ip: STRING, as_number: BIGINT, as_name: STRING, country_code: STRING>>")


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def alert(i, seconds, name, base="example.com", channel="c"):
    return (i, channel, at(seconds), name, base, ["tag"], False, (["192.0.2.7"], [], []), [])


def _stream(spark, schema, *batches):
    """A stream of the batches, one file and micro-batch each, in their order."""
    d = tempfile.mkdtemp(prefix="domsift-stream-")
    for i, rows in enumerate(batches):
        part = os.path.join(d, f"part{i}")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(part)
        for name in os.listdir(part):
            os.utime(os.path.join(part, name), (1_700_000_000 + 10 * i,) * 2)
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1)
    return reader.parquet(d)


def _run(spark, stream_df, name):
    q = stream_df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    return spark.sql(f"SELECT * FROM {name}")


def test_suppress_stream_equals_batch(spark):
    schema = "id INT, k STRING, ts TIMESTAMP"
    rnd = random.Random(5)
    rows = [(i, f"k{rnd.randrange(3)}", at(20 * i + rnd.randrange(5))) for i in range(60)]
    rows += [(60, "fine", at(1210)), (61, "fine", at(1259.9992)), (62, "fine", at(1260)), (63, "k0", None)]
    late = [(99, "k1", at(1))]  # behind the watermark: left out
    batches = [rows[:20], rows[20:40], rows[40:], late]
    src = _stream(spark, schema, *batches)
    got = {r.id: r.passed for r in _run(spark, ops.suppress_repeats_stream(src, "k", "ts", 50, order="id"), "sup1").collect()}
    want = {r.id: r.passed for r in suppress_repeats(spark.createDataFrame(rows, schema), "k", "ts", 50, order="id").collect()}
    assert (got[61], got[62]) == (False, True)
    assert got == want


def test_inflight_and_digest_window(spark):
    schema = "id INT, domain STRING, base_domain STRING, timestamp TIMESTAMP"
    rows = [(i, "a.com" if i % 2 else "b.com", "example.com" if i % 2 else None, at(i)) for i in range(10)]
    last = [(99, "late.com", None, at(3600))]  # moves the watermark past the first window
    once = _run(spark, ops.drop_inflight(_stream(spark, schema, rows[:4], rows[4:], last), "domain", "timestamp", "60 seconds"), "inflight1")
    assert once.where("domain = 'a.com'").count() == 1
    dig = _run(spark, ops.digest_window_stream(_stream(spark, schema, rows[:4], rows[4:], last), "timestamp", 300, "1 minute", order="id"), "digest1")
    counts = sorted((r.alert.domain, r.deduplicated_count) for r in dig.collect())
    assert ("a.com", 4) in counts and ("b.com", 4) in counts


def test_nxdomain_watch_stream_equals_batch(spark):
    schema = "id INT, domain STRING, observed_at TIMESTAMP, status STRING"
    seen = {
        "soon.test": [(0, "nxdomain"), (12, "success")],
        "gone.test": [(0, "nxdomain"), (11, "nxdomain"), (31, "nxdomain"), (80, "failure")],
        "slow.test": [(0, "nxdomain"), (40, "nxdomain"), (200, "success")],
        "overlap.test": [(0, "nxdomain"), (5, "success"), (8, "nxdomain"), (40, "success")],
        "second.test": [(0, "nxdomain"), (20, "success"), (100, "nxdomain"), (735, "success")],
        "repeat.test": [(0, "nxdomain"), (700, "nxdomain"), (710, "nxdomain"), (720, "success")],
        "never.test": [(0, "nxdomain"), (5, "nxdomain")],
    }
    rows = [(d, at(t), st) for d, obs in seen.items() for t, st in obs]
    rows = [(i, *r) for i, r in enumerate(sorted(rows, key=lambda r: r[1]))]
    end = [(98, "end.test", at(200_000), "success")]
    late = [(99, "soon.test", at(1), "success"), (100, "end.test", at(200_001), "success")]
    cuts = [[r for r in rows if lo <= (r[2] - T0).total_seconds() < hi] for lo, hi in ((0, 10), (10, 50), (50, 705), (705, 1000))]
    watch = ops.nxdomain_watch_stream(_stream(spark, schema, *cuts, end, late), order="id")
    key = lambda r: (r.domain, r.miss_at, r.outcome, r.attempt, r.resolved_at)
    got = sorted(map(str, map(key, _run(spark, watch, "nxw1").collect())))
    want = sorted(map(str, map(key, retry_outcome(spark.createDataFrame(rows, schema), order="id").collect())))
    assert got == want
    assert len(want) == 9 and sum("pending" in w for w in want) == 1


def test_digest_flush_stream_keeps_alerts_and_text(spark):
    one = [alert(1, 0, "b.example.com"), alert(2, 1, "a.example.com")]
    two = [alert(3, 2, "another.test", "another.test"),  # two domains: flushed, ticks begin anew
           alert(4, 10, "lone.test", None), alert(5, 11, "other.test", "other.test", channel="d")]
    three = [alert(6, 900, "later.test", "later.test")]
    late = [alert(7, 3, "example.com")]  # behind the watermark
    more = [alert(9, 901, "later.test", "later.test")]
    src = _stream(spark, ALERT, one, two, three, more, late, [alert(8, 5000, "end.test", "end.test")])
    out = _run(spark, ops.digest_flush_stream(src, "channel", "timestamp", 300, 2, order="id"), "dflush1").collect()
    got = {(r.channel, r.batch): r for r in out}
    assert {k: (r.groups, r.deduplicated) for k, r in got.items()} == {
        ("c", 0): (["example.com", "another.test"], [1, 0]), ("c", 1): (["lone.test"], [0]),
        ("c", 2): (["later.test"], [1]), ("d", 0): (["other.test"], [0])}
    assert got["c", 1].flushed_at == at(302)
    assert '"domain":"b.example.com"' in got["c", 0].alerts[0]
    lines = got["c", 0].text.split("\n")
    assert lines[0] == lines[-1] == "```" and len(lines) == 4
    assert "another.test" in lines[1] and "|b.example.com> (+1 more)" in lines[2]


def test_failure_rate_and_rate_report_streams(spark):
    schema = "id INT, resolver STRING, ts TIMESTAMP, failed BOOLEAN"
    rows = [(i, "r", at(i), i >= 4) for i in range(8)]
    batches = (rows[:3], rows[3:], [(9, "r", at(1000), False)], [(12, "r", at(1100), False)],
               [(10, "r", at(2), True)], [(11, "r", at(2000), False)])  # id 10 is behind the watermark
    out = _run(spark, ops.failure_rate_stream(_stream(spark, schema, *batches), "resolver", "ts", "failed", 8, 4, 0.9), "frate1").collect()
    got = {int((r.window.start - T0).total_seconds()): (r.checks, r.failures, r.alarm) for r in out}
    assert (got[-4], got[0], got[4]) == ((4, 0, False), (8, 4, False), (4, 4, True))
    report = _run(spark, ops.rate_report_stream(_stream(spark, schema, *batches), "ts", "resolver", 60), "rate1").collect()
    assert {int((r.window.start - T0).total_seconds()): r.n for r in report}[0] == 8


def test_stream_sinks_and_counts(spark):
    batches = [[alert(1, 0, "a.example.com")], [alert(2, 1, "b.example.com"), alert(3, 2, "c.example.com")], [alert(4, 3, "d.example.com")]]
    for formatter, mark in ((None, '"domain":"b.example.com"'), (format_plain, "[tag] b.example.com -> 192.0.2.7")):
        d = tempfile.mkdtemp(prefix="domsift-sink-")
        kw = {"formatter": formatter} if formatter else {}
        stream_alerts(_stream(spark, ALERT, *batches), f"{d}/out", f"{d}/ckpt", availableNow=True, **kw).awaitTermination(180)
        lines = [r.value for r in spark.read.text(f"{d}/out").collect()]
        assert len(lines) == 4 and sum(mark in x for x in lines) == 1

    def broken(batch, epoch):
        raise RuntimeError("down")

    kept, counted = [], []
    sinks = {"broken": broken, "all": lambda b, e: kept.extend(r.id for r in b.collect()), "some": lambda b, e: 1}
    query = _stream(spark, ALERT, *batches).writeStream.foreachBatch(fan_out(sinks, counted.extend)).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert sorted(kept) == [1, 2, 3, 4]
    assert counted[3:6] == [(1, "broken", 0, 2), (1, "all", 2, 0), (1, "some", 1, 1)]


def test_replayed_epochs_are_sent_and_counted_once(spark):
    d = tempfile.mkdtemp(prefix="domsift-ledger-")
    first, second = (spark.createDataFrame([alert(i, i, f"{i}.example.com") for i in ids], ALERT) for ids in ((1, 2), (3,)))
    sent, down, counted = [], [True], []

    def posts(batch, epoch):
        sent.extend(r.id for r in batch.collect())

    def shaky(batch, epoch):
        if down:
            raise RuntimeError("down")
        return batch.count()

    sinks = {"file": epoch_sink(f"{d}/out"), "posts": posts, "shaky": shaky}
    fan_out(sinks, counted.extend, f"{d}/ledger")(first, 0)
    down.clear()
    again = fan_out(sinks, counted.extend, f"{d}/ledger")  # a restarted query
    again(first, 0)
    again(second, 1)
    again(second, 1)
    assert sorted(sent) == [1, 2, 3]
    assert spark.read.text(f"{d}/out").count() == 3
    got = {(r.sink, r.epoch): (r.sent, r.failed) for r in ledger_counts(spark, f"{d}/ledger").collect()}
    assert got == {("file", 0): (2, 0), ("posts", 0): (2, 0), ("shaky", 0): (2, 0), ("file", 1): (1, 0), ("posts", 1): (1, 0), ("shaky", 1): (1, 0)}
    assert counted == [(0, "file", 2, 0), (0, "posts", 2, 0), (0, "shaky", 0, 2), (0, "shaky", 2, 0)] + [(1, s, 1, 0) for s in sinks]
    epoch_sink(f"{d}/out")(second, 1)  # lost before its entry: written again, not twice
    assert spark.read.text(f"{d}/out").count() == 3


def test_sketch_batch_and_stream(spark):
    schema = "ts TIMESTAMP, status STRING, latency DOUBLE"
    draw = random.Random(2)
    rows = [(at(i), draw.choice("ab"), draw.choice([0.0, -1.0, draw.expovariate(3), draw.lognormvariate(0, 4)])) for i in range(900)]
    odd = [(at(5), "a", None), (at(5), "a", float("nan")), (at(5), "b", float("inf"))]
    given = spark.createDataFrame(rows + odd, schema)
    exact = {s: sorted(max(v, 0.0) for _, k, v in rows if k == s) for s in "ab"}
    hourly = quantile_sketch(given, [F.window("ts", "60 seconds").alias("w"), "status"], "latency", 0.02)
    for r in sketch_quantiles(merge_sketches(hourly, ["status"]), ["status"], (0.0, 0.25, 0.5, 0.999, 1.0), 0.02).collect():
        values = exact[r.status]
        assert r.n == len(values)
        for q, name in ((0.0, "p0"), (0.25, "p25"), (0.5, "p50"), (0.999, "p99_9"), (1.0, "p100")):
            want = values[max(-int(-len(values) * q // 1), 1) - 1]
            assert abs(r[name] - want) <= 0.02 * want + 1e-9
    src = _stream(spark, schema, rows[:400], rows[400:], [(at(5000), "z", 1.0)]).withWatermark("ts", "1 minute")
    live = _run(spark, quantile_sketch(src, [F.window("ts", "60 seconds").alias("w"), "status"], "latency", 0.02), "sketch1")
    whole = lambda df: sorted((r.w.start, r.status, r.bucket, r.n) for r in df.collect() if r.status != "z")
    assert whole(live) == whole(hourly)
    assert sketch_quantiles(merge_sketches(hourly.limit(0), ["status"]), ["status"]).count() == 0
