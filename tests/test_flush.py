"""Digests by size or tick: the batch form against a plain loop and against the stream."""

import random

import pytest
from test_streaming import ALERT, _run, _stream, alert, at

from domsift.operators import flush
from domsift.operators.flush import digest_flush
from domsift.streaming import ops


def plain(rows, width, size):
    """{(channel, batch): (flushed at, reason, domains, further alerts)} of (seconds, channel, domain), one after another."""
    out, state = {}, {}
    for t, channel, name in rows:
        s = state.setdefault(channel, {"tick": t + width, "pending": {}, "n": 0})
        while t >= s["tick"]:
            if s["pending"]:
                out[channel, s["n"]] = (s["tick"], "tick", s["pending"])
                s["n"], s["pending"] = s["n"] + 1, {}
            s["tick"] += width
        s["pending"][name] = s["pending"].get(name, -1) + 1
        if len(s["pending"]) == size:
            out[channel, s["n"]] = (t, "size", s["pending"])
            s["n"], s["pending"], s["tick"] = s["n"] + 1, {}, t + width
    for channel, s in state.items():
        if s["pending"]:
            out[channel, s["n"]] = (s["tick"], "tick", s["pending"])
    return {k: (at(t), reason, list(p), list(p.values())) for k, (t, reason, p) in out.items()}


def made(seed, n, gaps, names):
    draw, t, rows = random.Random(seed), 0, []
    for _ in range(n):
        t += draw.choice(gaps)
        rows.append((t, draw.choice(["c", "c", "c", "d"]), f"n{draw.randrange(names)}.test"))
    return rows


@pytest.mark.parametrize(
    "rows, width, size, bucket",
    [
        (made(1, 500, [0, 1, 2, 9], 20), 30, 4, 30),  # sent by size and by tick, smallest buckets
        (made(2, 500, [0, 1, 2, 9], 20), 30, 4, 200),
        (made(3, 400, [0, 1, 3, 40, 300], 6), 50, 3, 60),  # gaps over empty buckets
        (made(4, 300, [1], 10_000), 60, 7, 60),  # all different: nearly all sent by size
        (made(5, 300, [5, 60, 500], 3), 20, 50, 100),  # never sent by size
        (made(6, 300, [0, 0, 0, 7], 4), 10, 1, 10),  # each alert at once
        (made(7, 400, [0, 4, 11], 5), 25, 4, 25),  # size reached here and there
    ],
)
def test_digest_flush_equals_plain_loop(spark, rows, width, size, bucket):
    df = spark.createDataFrame([alert(i, t, name, None, channel) for i, (t, channel, name) in enumerate(rows)], ALERT).repartition(5)
    got = digest_flush(df, "channel", "timestamp", width, size, "id", bucket).collect()
    assert {(r.channel, r.batch): (r.flushed_at, r.reason, r.groups, r.deduplicated) for r in got} == plain(rows, width, size)
    assert all(r.entries == len(r.groups) == len(r.alerts) == len(r.text.split("\n")) - 2 for r in got)


def test_texts_stay_out_of_the_looks_along_a_channel(spark, monkeypatch):
    rows, seen, look = made(9, 200, [0, 1, 2, 9], 12), [], flush.look
    monkeypatch.setattr(flush, "look", lambda df, *a, **k: seen.append(df.columns) or look(df, *a, **k))
    monkeypatch.setattr(flush, "TEXTS_PER_TASK", 30)
    df = spark.createDataFrame([alert(i, t, name, None, channel) for i, (t, channel, name) in enumerate(rows)], ALERT).repartition(5)
    got = digest_flush(df, "channel", "timestamp", 30, 4, "id", 60).collect()
    assert {(r.channel, r.batch): (r.flushed_at, r.reason, r.groups, r.deduplicated) for r in got} == plain(rows, 30, 4)
    assert all(name in r.text and name in r.alerts[i] for r in got for i, name in enumerate(r.groups))
    assert seen and not any("_entry" in columns for columns in seen)


def test_digest_flush_equals_stream(spark):
    rows = [alert(i, t, f"w.{name}", name, channel) for i, (t, channel, name) in enumerate(made(8, 120, [0, 1, 2, 30], 9))]
    src = _stream(spark, ALERT, rows[:50], rows[50:51], rows[51:], [alert(999, 9000, "end.test", "end.test", "z")])
    sent = _run(spark, ops.digest_flush_stream(src, "channel", "timestamp", 40, 4, order="id"), "dflush2").collect()
    batch = digest_flush(spark.createDataFrame(rows, ALERT), "channel", "timestamp", 40, 4, "id").collect()
    fields = ("channel", "batch", "flushed_at", "entries", "groups", "deduplicated", "alerts", "text")
    whole = lambda all_rows: sorted(tuple(r[f] for f in fields) for r in all_rows if r.channel != "z")
    assert whole(sent) == whole(batch) and len({r.reason for r in batch}) == 2


def test_digest_flush_of_nulls_and_nothing(spark):
    odd = [alert(1, 0, "a.test", None, None), alert(2, 1, None, None, None), (3, "c", None, "b.test", None, ["tag"], False, None, None)]
    df = spark.createDataFrame(odd, ALERT)
    got = digest_flush(df, "channel", "timestamp", 10, 5, "id").collect()
    assert [(r.channel, r.entries, r.groups, r.flushed_at) for r in got] == [(None, 2, ["a.test", None], at(10))]
    assert digest_flush(df.limit(0), "channel", "timestamp", 10, 5, "id").count() == 0
    with pytest.raises(ValueError):
        digest_flush(df, "channel", batch_size=0)
