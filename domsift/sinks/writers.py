"""Alert sinks: JSON lines, plain lines, digest payloads, fan-out."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from domsift.functions.text import alert_json, format_plain
from domsift.operators.digest import digest_payload

log = logging.getLogger(__name__)


def write_alerts_json(alerts: DataFrame, path: str, mode: str = "append") -> None:
    """One JSON object per line (the alert record, nulls omitted)."""
    alerts.select(alert_json().alias("value")).write.mode(mode).text(path)


def write_alerts_text(
    alerts: DataFrame, path: str, mode: str = "append", formatter: Callable[[], Column] = format_plain
) -> None:
    alerts.select(formatter().alias("value")).write.mode(mode).text(path)


def stream_alerts(
    alerts: DataFrame, path: str, checkpoint: str, formatter: Callable[[], Column] = alert_json, **trigger
) -> StreamingQuery:
    """Start a file sink of one line per alert (JSON, or ``formatter=format_plain``), each alert once.

    ``trigger`` is what ``DataStreamWriter.trigger`` takes, e.g. ``availableNow=True``.
    """
    lines = alerts.select(formatter().alias("value"))
    writer = lines.writeStream.format("text").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start(path)


def write_digests(digests: DataFrame, path: str, mode: str = "append") -> None:
    """Digest webhook bodies ``{"text": ...}`` as JSON lines (posting them is the user's sink)."""
    digest_payload(digests).select(F.col("payload").alias("value")).write.mode(mode).text(path)


def _written(spark: SparkSession, path: str) -> bool:
    """Whether a whole output stands at ``path`` (on whatever file system it names)."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def epoch_sink(path: str, formatter: Callable[[], Column] = alert_json) -> Callable[[DataFrame, int], None]:
    """A sink of one line per alert below ``path/epoch=N``: an epoch that comes again replaces its own lines."""

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.select(formatter().alias("value")).write.mode("overwrite").text(f"{path}/epoch={epoch}")

    return sink


def ledger_counts(spark: SparkSession, ledger: str) -> DataFrame:
    """(``sink``, ``epoch``, ``sent``, ``failed``) of a ledger folder, each sink and epoch once."""
    return spark.read.schema("sent BIGINT, failed BIGINT, sink STRING, epoch BIGINT").parquet(ledger).select("sink", "epoch", "sent", "failed")


def fan_out(
    sinks: dict[str, Callable[[DataFrame, int], int | None]],
    counts: Callable[[list[tuple[int, str, int, int]]], None] | None = None,
    ledger: str | None = None,
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body: every alert to every sink; a failing sink does not stop the others.

    The batch is persisted once for all sinks.  ``counts`` gets one row
    ``(epoch, sink, sent, failed)`` for each sink: ``sent`` is the number the
    sink returns, or the whole batch if it returns none; all alerts of a sink
    that raises count as failed (what it wrote before is not known).

    ``ledger`` is a shared folder of this query alone. A sink that took an epoch
    is entered there, and left out (of ``counts`` too) when the epoch comes
    again; one that failed is tried again. A sink that is lost between its
    writing and its entry gets the epoch twice, so it should replace what it
    wrote, as ``epoch_sink`` does. ``ledger_counts`` reads the entries. Sink
    names become folder names.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            n = batch.count()
            rows = []
            for name, sink in sinks.items():
                entry = f"{ledger}/sink={name}/epoch={epoch}"
                try:
                    if ledger and _written(batch.sparkSession, entry):
                        log.info("sink %s: epoch %d came again, left out", name, epoch)
                        continue
                    took = sink(batch, epoch)
                    sent = n if took is None else int(took)
                    if ledger:
                        one = batch.sparkSession.createDataFrame([(sent, n - sent)], "sent BIGINT, failed BIGINT")
                        one.coalesce(1).write.mode("overwrite").parquet(entry)
                    rows.append((epoch, name, sent, n - sent))
                    log.info("sink %s: sent %d of %d alerts (epoch %d)", name, sent, n, epoch)
                except Exception:  # noqa: BLE001 - one output failing must not stop the others
                    rows.append((epoch, name, 0, n))
                    log.exception("sink %s failed for epoch %d", name, epoch)
            if counts:
                counts(rows)
        finally:
            batch.unpersist()

    return run
