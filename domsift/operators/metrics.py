"""Counters of the pipeline as aggregations (batch) or observed metrics (stream)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dns_status_counts(df: DataFrame, status: str = "status") -> DataFrame:
    """Observations per status; each observation counted once."""
    return df.groupBy(status).agg(F.count(F.lit(1)).cast("bigint").alias("queries"))


def dns_latency_summary(df: DataFrame, latency: str = "latency_s", status: str = "status", exact: bool = False) -> DataFrame:
    """Count, sum and quantiles (p50/p90/p95/p99) of resolution latency, per status.

    ``exact=False`` uses ``percentile_approx`` (a mergeable sketch, one pass,
    partial aggregation); ``exact=True`` uses nearest-rank exact percentiles.
    """
    qs = [0.5, 0.9, 0.95, 0.99]
    if exact:
        qcols = [
            F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {latency})").alias(f"p{int(q * 100)}") for q in qs
        ]
    else:
        qcols = [F.percentile_approx(latency, q, 10000).alias(f"p{int(q * 100)}") for q in qs]
    return df.groupBy(status).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.round(F.sum(latency), 6).alias("total_s"),
        *qcols,
    )


def pipeline_counts(
    feed: DataFrame,
    sampled: DataFrame | None = None,
    kept: DataFrame | None = None,
    alerts: DataFrame | None = None,
    passed: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Ingested / sampled / not ignored / alerted / passed-dedup totals, one DataFrame each."""
    out = {"ingested": feed.agg(F.count(F.lit(1)).cast("bigint").alias("n"))}
    for name, df in (("sampled", sampled), ("kept", kept), ("alerts", alerts), ("passed", passed)):
        if df is not None:
            out[name] = df.agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    return out


def rate_report(df: DataFrame, ts: str, key: str, width_seconds: int = 60) -> DataFrame:
    """Rows per second per key in tumbling windows of ``width_seconds``."""
    w = F.window(F.col(ts), f"{width_seconds} seconds")
    return df.groupBy(w.getField("start").alias("window_start"), F.col(key)).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.round(F.count(F.lit(1)) / F.lit(float(width_seconds)), 6).alias("per_second"),
    )
