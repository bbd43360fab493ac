"""Structured Streaming forms of the operators.

Each stream operator has a batch twin in ``domsift.operators`` and is tested
against it.  Event time is the ``seen_at``/``timestamp`` column (cast to
``TIMESTAMP`` at the source: watermarks refuse ``TIMESTAMP_NTZ``).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from domsift.functions.dns import SUCCESS, dns_status
from domsift.operators import rules as rules_mod
from domsift.operators.digest import FENCE, aggregate_alerts, digest_entry
from domsift.operators.dns import RetryConfig, nxdomain_offsets_s

try:  # Spark 4: Python stateful processors
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
except Exception:  # pragma: no cover
    StatefulProcessor = object  # type: ignore[misc,assignment]
    StatefulProcessorHandle = object  # type: ignore[misc,assignment]


def _micros(times: pd.Series) -> list[int | None]:
    """Microseconds since the epoch, None for a missing time."""
    t = pd.to_datetime(times, utc=True).astype("datetime64[us, UTC]")
    return [None if missing else us for missing, us in zip(t.isna().tolist(), t.astype("int64").tolist())]


def _in_order(rows, ts: str, order: str | None) -> pd.DataFrame:
    """A micro-batch's rows of one key by (time, order), with ``_us``; rows without a time first."""
    pdf = pd.concat(list(rows), ignore_index=True)
    pdf = pdf.assign(_us=pd.Series(_micros(pdf[ts]), dtype="Int64"))
    return pdf.sort_values(["_us"] + ([order] if order else []), kind="stable", na_position="first")


def _utc(us: int | None) -> pd.Timestamp | None:
    return None if us is None else pd.Timestamp(us, unit="us", tz="UTC")


def _set_timer(handle, us: int) -> None:
    """One timer a key, at the first whole millisecond not before ``us``."""
    for old in list(handle.listTimers()):
        handle.deleteTimer(old)
    handle.registerTimer(-(-us // 1000))


class _SuppressProcessor(StatefulProcessor):
    """Per key: pass a row when ``ts >= last_passed + ttl``; the row order inside
    a micro-batch is (ts, order).  An event-time timer clears the key once its
    hold has expired, so state is bounded by the ttl, not by the key count."""

    def __init__(self, ttl_us: int, ts: str, order: str | None):
        self.ttl_us = ttl_us
        self.ts = ts
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last_passed_us", T.StructType([T.StructField("t", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _in_order(rows, self.ts, self.order)
        last = before = self.last.get()[0] if self.last.exists() else None
        passed = []
        for t in pdf["_us"].tolist():
            if pd.isna(t):  # without a time: passes, holds nothing back
                passed.append(True)
            elif last is None or t >= last + self.ttl_us:
                last = t
                passed.append(True)
            else:
                passed.append(False)
        if last != before:
            self.last.update((int(last),))
            _set_timer(self.handle, int(last) + self.ttl_us)
        yield pdf.drop(columns=["_us"]).assign(passed=passed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def suppress_repeats_stream(
    df: DataFrame, key: str, ts: str, ttl_seconds: float, order: str | None = None, watermark: str = "10 minutes"
) -> DataFrame:
    """Streaming twin of ``suppress_repeats``: adds ``passed`` to every row.

    Micro-batches are taken as they come, so alerts are not held until the
    watermark; a row older than its key's last passed one is a repeat.
    """
    schema = T.StructType(df.schema.fields + [T.StructField("passed", T.BooleanType(), False)])
    return (
        df.withWatermark(ts, watermark)
        .groupBy(key)
        .transformWithStateInPandas(
            statefulProcessor=_SuppressProcessor(int(round(ttl_seconds * 1_000_000)), ts, order),
            outputStructType=schema,
            outputMode="Append",
            timeMode="EventTime",
        )
    )


def drop_inflight(df: DataFrame, domain: str, ts: str, ttl: str = "60 seconds") -> DataFrame:
    """Process a name once while it is in flight (within the watermark delay)."""
    return df.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([domain])


def digest_window_stream(
    alerts: DataFrame, ts: str = "timestamp", width_seconds: int = 300, watermark: str = "1 minute", order: str | None = None
) -> DataFrame:
    """Time-flushed digest groups: one representative per registrable domain and window.

    Append mode emits a window once the watermark passes its end.
    """
    win = F.window(F.col(ts), f"{width_seconds} seconds")
    wm = alerts.withWatermark(ts, watermark)
    return aggregate_alerts(wm, [win.alias("window")], ts, order).drop("_first")


def rate_report_stream(df: DataFrame, ts: str, key: str, width_seconds: int = 60, watermark: str = "1 minute") -> DataFrame:
    w = F.window(F.col(ts), f"{width_seconds} seconds")
    return (
        df.withWatermark(ts, watermark)
        .groupBy(w.alias("window"), F.col(key))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("per_second", F.col("n") / F.lit(float(width_seconds)))
    )


def failure_rate_stream(
    df: DataFrame, group: str, ts: str, failed: str, window_seconds: int = 120, slide_seconds: int = 10,
    threshold: float = 0.95, watermark: str = "1 minute",
) -> DataFrame:
    """Share of failed checks in sliding windows, with ``alarm`` at the threshold; final once the watermark passes."""
    w = F.window(F.col(ts), f"{window_seconds} seconds", f"{slide_seconds} seconds")
    per = df.withWatermark(ts, watermark).groupBy(w.alias("window"), F.col(group)).agg(
        F.count(F.lit(1)).alias("checks"), F.count_if(F.col(failed)).alias("failures")
    )
    rate = F.col("failures") / F.col("checks")
    return per.withColumn("failure_rate", F.round(rate, 6)).withColumn("alarm", rate >= F.lit(threshold))


def attach_dns_stream(
    feed: DataFrame, dns: DataFrame, horizon_seconds: float, domain: str = "domain", seen: str = "seen_at",
    observed: str = "observed_at", order: str | None = None, watermark: str = "1 minute",
) -> DataFrame:
    """Stream twin of ``attach_dns_within``: a stream of names meets a stream of DNS observations.

    Both sides wait for each other: a name for answers until ``horizon_seconds``
    after it was seen, an answer for names that are still on their way. The
    bounds on both times let either state go once the watermark has passed them.
    A name's first answer is final, and comes out, when its horizon has passed;
    names without one never come out. Rows of the feed that are equal in every
    column are one.
    """
    added = [c for c in dns.columns if c != domain]
    names = feed.withWatermark(seen, watermark)
    answers = dns.where(dns_status() == F.lit(SUCCESS)).withColumnRenamed(domain, "_d").withWatermark(observed, watermark)
    horizon = F.expr(f"INTERVAL {int(round(horizon_seconds * 1_000_000))} MICROSECONDS")
    met = names.join(
        answers, (F.col(domain) == F.col("_d")) & (F.col(observed) >= F.col(seen)) & (F.col(observed) <= F.col(seen) + horizon)
    )
    first = F.min_by(F.struct(*added), F.struct(observed, *([order] if order else []))).alias("_answer")
    return met.groupBy(*feed.columns).agg(first).select(*feed.columns, "_answer.*")


def enrich_stream(names: DataFrame, enriched_answers: DataFrame, domain: str = "domain") -> DataFrame:
    """Stream-static equi-join with the pre-enriched answer table (no regrouping on the stream)."""
    return names.join(enriched_answers, domain, "inner")


def with_rules_reload(load_rules: Callable[[], rules_mod.RuleSet], sink: Callable[[DataFrame, int], None]):
    """``foreachBatch`` body that re-reads the rule set for every micro-batch."""

    def run(batch: DataFrame, epoch: int) -> None:
        rs = load_rules()
        sink(rules_mod.match_rules(batch, rs), epoch)

    return run


class _NxWatchProcessor(StatefulProcessor):
    """Per name: follow the re-checks of every NXDOMAIN run that is still open.

    State holds the open runs as (miss time, due times answered) and whether
    the last observation was NXDOMAIN (such a one opens no second run).  An
    observation answers all due times of a run up to its own time: a success
    resolves the run, another outcome or the last due time gives it up.  Runs
    without an answer until ``expire`` after the name's last observation end
    as pending, and the name is forgotten."""

    def __init__(self, offsets_us: list[int], expire_us: int, ts: str, status: str, order: str | None):
        self.offsets = offsets_us
        self.expire = expire_us
        self.ts = ts
        self.status = status
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.watch = handle.getValueState(
            "watch", T.StructType([T.StructField("runs", T.StringType()), T.StructField("missing", T.BooleanType())])
        )

    def _load(self) -> tuple[list, bool]:
        if not self.watch.exists():
            return [], False
        runs, missing = self.watch.get()
        return json.loads(runs), missing

    def _rows(self, key, ended: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({
            "domain": [key[0]] * len(ended),
            "miss_at": [_utc(miss) for miss, *_ in ended],
            "outcome": [outcome for _, outcome, *_ in ended],
            "attempt": pd.Series([attempt for *_, attempt, _ in ended], dtype="Int64"),
            "resolved_at": pd.Series([_utc(at) for *_, at in ended], dtype="datetime64[us, UTC]"),
        })

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _in_order(rows, self.ts, self.order).dropna(subset=["_us"])
        runs, missing = self._load()
        ended, t = [], None
        for t, status in zip(pdf["_us"].tolist(), pdf[self.status].tolist()):
            still = []
            for miss, answered in runs:
                due = sum(miss + o <= t for o in self.offsets)
                if due <= answered:
                    still.append((miss, answered))
                elif status == "success":
                    ended.append((miss, "resolved", answered + 1, t))
                elif status == "nxdomain" and due < len(self.offsets):
                    still.append((miss, due))
                else:
                    ended.append((miss, "gave_up", None, None))
            if status == "nxdomain" and not missing:
                still.append((t, 0))
            runs, missing = still, status == "nxdomain"
        if t is not None:
            if runs or missing:
                self.watch.update((json.dumps(runs), missing))
                _set_timer(self.handle, int(t) + self.expire)
            elif self.watch.exists():
                self.watch.clear()
                for old in list(self.handle.listTimers()):
                    self.handle.deleteTimer(old)
        if ended:
            yield self._rows(key, ended)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        runs, _ = self._load()
        self.watch.clear()
        if runs:
            yield self._rows(key, [(miss, "pending", None, None) for miss, _ in runs])

    def close(self) -> None:
        pass


NX_WATCH_SCHEMA = T.StructType(
    [
        T.StructField("domain", T.StringType()),
        T.StructField("miss_at", T.TimestampType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("attempt", T.LongType()),
        T.StructField("resolved_at", T.TimestampType()),
    ]
)


def nxdomain_watch_stream(
    obs: DataFrame,
    domain: str = "domain",
    ts: str = "observed_at",
    status: str = "status",
    cfg=None,
    order: str | None = None,
    watermark: str = "1 minute",
    expire_seconds: float = 86400,
) -> DataFrame:
    """Streaming twin of ``retry_outcome``: one row per NXDOMAIN run once it is decided.

    ``expire_seconds`` bounds the state: a name not seen for so long ends its
    open runs as pending.
    """
    offsets = [int(round(s * 1_000_000)) for s in nxdomain_offsets_s(cfg or RetryConfig())]
    return (
        obs.withWatermark(ts, watermark)
        .groupBy(domain)
        .transformWithStateInPandas(
            statefulProcessor=_NxWatchProcessor(offsets, int(expire_seconds * 1_000_000), ts, status, order),
            outputStructType=NX_WATCH_SCHEMA,
            outputMode="Append",
            timeMode="EventTime",
        )
    )


class _DigestFlushProcessor(StatefulProcessor):
    """Per channel: collect alerts per registrable domain and flush a batch when
    ``batch_size`` distinct domains are pending or the flush tick passes.

    Ticks run every ``width`` from the channel's first alert; a size flush
    restarts them, a tick with nothing pending sends nothing.  Rows are
    compared with the tick before they join the batch (a late tick flushes
    first).  A domain keeps its first alert and counts the others, so pending
    state is at most ``batch_size`` alerts.  Rows come with ``group`` (the
    domain), ``sort_key`` (as JSON), ``head`` and ``tail`` (the line around the
    count) and ``alert`` (as JSON); names that begin with an underscore would
    not reach the processor."""

    def __init__(self, width_us: int, batch_size: int, ts: str, order: str | None):
        self.width = width_us
        self.size = batch_size
        self.ts = ts
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState(
            "digest", T.StructType([T.StructField("tick", T.LongType()), T.StructField("pending", T.StringType()),
                                    T.StructField("n", T.LongType())])
        )

    def _load(self) -> tuple[int | None, dict, int]:
        if not self.state.exists():
            return None, {}, 0
        tick, pending, n = self.state.get()
        return tick, dict(json.loads(pending)), n

    def _flush(self, key, pending: dict, n: int, at_us: int) -> pd.DataFrame:
        more = lambda count: f" (+{count} more)" if count else ""
        lines = sorted((sort_key, head + more(count) + tail) for count, sort_key, head, tail, _ in pending.values())
        return pd.DataFrame({
            "channel": [key[0]], "batch": [n], "flushed_at": [_utc(at_us)], "entries": [len(pending)],
            "groups": [list(pending)],
            "deduplicated": [[count for count, *_ in pending.values()]],
            "alerts": [[alert for *_, alert in pending.values()]],
            "text": ["\n".join([FENCE, *[line for _, line in lines], FENCE])],
        })

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _in_order(rows, self.ts, self.order).dropna(subset=["_us"])
        if pdf.empty:
            return
        tick, pending, n = self._load()
        out = []
        cols = [pdf[c].tolist() for c in ("_us", "group", "sort_key", "head", "tail", "alert")]
        for t, g, sort_key, head, tail, alert in zip(*cols):
            if tick is None:
                tick = t + self.width
            if t >= tick:
                if pending:
                    out.append(self._flush(key, pending, n, tick))
                    n, pending = n + 1, {}
                tick += ((t - tick) // self.width + 1) * self.width
            if g in pending:
                pending[g][0] += 1
            else:
                pending[g] = [0, json.loads(sort_key), head, tail, alert]
            if len(pending) >= self.size:
                out.append(self._flush(key, pending, n, t))
                n, pending = n + 1, {}
                tick = t + self.width
        self.state.update((int(tick), json.dumps(list(pending.items())), int(n)))
        if pending:
            _set_timer(self.handle, int(tick))
        else:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
        if out:
            yield pd.concat(out, ignore_index=True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        tick, pending, n = self._load()
        if pending:
            self.state.update((int(tick) + self.width, "[]", int(n) + 1))
            yield self._flush(key, pending, n, tick)

    def close(self) -> None:
        pass


DIGEST_FLUSH_SCHEMA = T.StructType([
    T.StructField("channel", T.StringType()), T.StructField("batch", T.LongType()),
    T.StructField("flushed_at", T.TimestampType()), T.StructField("entries", T.LongType()),
    T.StructField("groups", T.ArrayType(T.StringType())), T.StructField("deduplicated", T.ArrayType(T.LongType())),
    T.StructField("alerts", T.ArrayType(T.StringType())), T.StructField("text", T.StringType()),
])


def digest_flush_stream(
    alerts: DataFrame, channel: str, ts: str = "timestamp", width_seconds: float = 300,
    batch_size: int = 50, order: str | None = None, watermark: str = "1 minute",
) -> DataFrame:
    """Digests of alert records, flushed by size or by tick, per channel (see ``_DigestFlushProcessor``).

    One row per digest: the registrable domains in order of arrival with the
    number of further alerts and the first alert (JSON) of each, and the
    digest text, its lines sorted as in ``digest_batches``. ``digest_flush`` is
    the batch twin.
    """
    e = digest_entry(ts)
    rows = alerts.withWatermark(ts, watermark).select(
        F.col(channel).cast("string").alias("channel"), F.col(ts), *([F.col(order)] if order else []),
        e["group"].alias("group"), F.to_json(e["sort_key"]).alias("sort_key"), e["head"].alias("head"), e["tail"].alias("tail"),
        e["alert"].alias("alert"),
    )
    return rows.groupBy("channel").transformWithStateInPandas(
        statefulProcessor=_DigestFlushProcessor(int(round(width_seconds * 1_000_000)), batch_size, ts, order),
        outputStructType=DIGEST_FLUSH_SCHEMA,
        outputMode="Append",
        timeMode="EventTime",
    )
