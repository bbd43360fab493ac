"""DNS-observation operators: status, health, failure rate, first resolution, retries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domsift.functions.dns import NXDOMAIN, SUCCESS, dns_error_text, dns_status
from domsift.operators.dedup import epoch_micros
from domsift.operators.scan import look, trailing
from domsift.operators.store import stored

# Health events.
UNHEALTHY, REMAINS_UNHEALTHY, RECOVERED = "UNHEALTHY", "REMAINS_UNHEALTHY", "RECOVERED"


@dataclass(frozen=True)
class RetryConfig:
    """Retry settings with the source system's defaults (milliseconds)."""

    retries: int = 3
    backoff_ms: int = 500
    nxdomain_retries: int = 5
    nxdomain_backoff_ms: int = 10_000


def with_status(df: DataFrame) -> DataFrame:
    """Add ``status`` and ``error`` to a ``dns_obs`` table."""
    return df.withColumn("status", dns_status()).withColumn("error", dns_error_text())


def health_transitions(df: DataFrame, group: str, ts: str, ok: str, order: str | None = None) -> DataFrame:
    """Health state machine per ``group``: starts healthy, follows the last check.

    ``event`` is UNHEALTHY on a first failure, REMAINS_UNHEALTHY on a repeated
    failure, RECOVERED on the first success after failures, null otherwise.
    """
    told = look(df, [group], epoch_micros(df, ts), F.col(ok), "_prev", [order] if order else [])
    prev = F.coalesce(F.col("_prev"), F.lit(True))
    event = (
        F.when(~F.col(ok) & prev, F.lit(UNHEALTHY))
        .when(~F.col(ok) & ~prev, F.lit(REMAINS_UNHEALTHY))
        .when(F.col(ok) & ~prev, F.lit(RECOVERED))
    )
    return told.withColumn("healthy", F.col(ok)).withColumn("event", event).drop("_prev")


def failure_rate(
    df: DataFrame, group: str, ts: str, failed: str, window_seconds: int = 120, threshold: float = 0.95
) -> DataFrame:
    """Share of failed checks in the trailing ``window_seconds`` (inclusive range frame)."""
    sums = {"checks": F.lit(1).cast("bigint"), "failures": F.col(failed).cast("bigint")}
    rated = trailing(df, [group], epoch_micros(df, ts), window_seconds, sums)
    share = F.col("failures") / F.col("checks")
    return rated.withColumn("failure_rate", F.round(share, 6)).withColumn("alarm", share >= F.lit(threshold))


def nxdomain_offsets_s(cfg: RetryConfig) -> list[float]:
    """Seconds after the first miss at which NXDOMAIN re-checks are due."""
    b = cfg.nxdomain_backoff_ms / 1000.0
    return [b * (2 ** (i + 1) - 1) for i in range(cfg.nxdomain_retries + 1)]


def first_resolution(
    df: DataFrame,
    domain: str = "domain",
    ts: str = "observed_at",
    status: str = "status",
    order: str | None = None,
    horizon_seconds: float | None = None,
) -> DataFrame:
    """Flag ``resolved_after_nxdomain``: the first success after an NXDOMAIN of the same name.

    Every NXDOMAIN opens a watch; the next success closes all open ones and is
    flagged if the latest of them began at most ``horizon_seconds`` before
    (default: when the re-checks run out).  Failures and timeouts between
    change nothing.
    """
    if horizon_seconds is None:
        horizon_seconds = nxdomain_offsets_s(RetryConfig())[-1]
    us = epoch_micros(df, ts)
    seen = F.when(F.col(status).isin(NXDOMAIN, SUCCESS), F.struct(F.col(status).alias("s"), us.alias("us")))
    told = look(df, [domain], us, seen, "_last", [order] if order else [])
    flag = (
        (F.col(status) == F.lit(SUCCESS))
        & (F.col("_last.s") == F.lit(NXDOMAIN))
        & (us - F.col("_last.us") <= F.lit(int(round(horizon_seconds * 1_000_000))))
    )
    return told.withColumn("resolved_after_nxdomain", F.coalesce(flag, F.lit(False))).drop("_last")


def retry_schedule(df: DataFrame, ts: str = "observed_at", status: str = "status", cfg: RetryConfig = RetryConfig()) -> DataFrame:
    """Due times of re-checks after each failed observation.

    NXDOMAIN: first re-check after ``B``, then doubling waits, ``N + 1``
    re-checks, due at ``B * (2^(i+1) - 1)``.  Other failures: try ``i`` of
    ``retries + 1`` is due at ``b * (2^i - 1)``.  Output one row per
    (observation, attempt) with ``attempt`` (1-based) and ``due_at``.
    """
    nx = F.col(status) == F.lit(NXDOMAIN)
    n = F.when(nx, F.lit(cfg.nxdomain_retries)).otherwise(F.lit(cfg.retries))
    i = F.col("_i")
    b_nx = F.lit(cfg.nxdomain_backoff_ms)
    b_std = F.lit(cfg.backoff_ms)
    offset_ms = F.when(nx, b_nx * (F.pow(F.lit(2), i + 1) - 1)).otherwise(b_std * (F.pow(F.lit(2), i) - 1))
    failed = df.where(F.col(status) != F.lit(SUCCESS))
    return failed.select(
        "*",
        F.explode(F.sequence(F.lit(0), n)).alias("_i"),
    ).select(
        *failed.columns,
        (F.col("_i") + 1).alias("attempt"),
        (F.col(ts) + F.make_dt_interval(secs=(offset_ms / 1000.0).cast("decimal(18,6)"))).alias("due_at"),
    )


def retry_outcome(
    df: DataFrame,
    domain: str = "domain",
    ts: str = "observed_at",
    status: str = "status",
    cfg: RetryConfig = RetryConfig(),
    order: str | None = None,
) -> DataFrame:
    """For each NXDOMAIN miss that starts a run: resolved / gave_up / pending.

    Each re-check due time is aligned with the first observation of the same
    name at or after it (an as-of lookup done with a union and a look ahead, so
    no pairs are formed); the first aligned observation
    that is not NXDOMAIN decides: success -> ``resolved`` at that attempt,
    any other error -> ``gave_up``; all NXDOMAIN -> ``gave_up``; a due time
    with nothing observed yet -> ``pending``.
    """
    tie = [order] if order else []
    df = stored(df.select(domain, ts, status, *tie), "observations")
    told = look(df, [domain], epoch_micros(df, ts), F.col(status), "_prev", tie)
    starts = told.where((F.col(status) == F.lit(NXDOMAIN)) & (F.coalesce(F.col("_prev"), F.lit("")) != F.lit(NXDOMAIN))).select(
        F.col(domain).alias("_d"), F.col(ts).alias("miss_at")
    )
    offs = nxdomain_offsets_s(cfg)
    sched = starts.select(
        "_d",
        "miss_at",
        F.posexplode(F.array(*[F.lit(o) for o in offs])).alias("_a", "_off"),
    ).select(
        "_d",
        "miss_at",
        (F.col("_a") + 1).alias("attempt"),
        (F.col("miss_at") + F.make_dt_interval(secs=F.col("_off").cast("decimal(18,6)"))).alias("due_at"),
    )
    obs = df.select(
        F.col(domain).alias("_d"),
        F.col(ts).alias("_t"),
        F.lit(1).alias("_kind"),  # observations sort after schedule rows at equal time
        F.col(status).alias("_s"),
        F.lit(None).cast(sched.schema["miss_at"].dataType).alias("miss_at"),
        F.lit(None).cast("int").alias("attempt"),
        *[F.col(c).alias("_o") for c in tie],
    )
    sch = sched.select(
        "_d",
        F.col("due_at").alias("_t"),
        F.lit(0).alias("_kind"),
        F.lit(None).cast("string").alias("_s"),
        "miss_at",
        "attempt",
        *[F.lit(None).cast(df.schema[c].dataType).alias("_o") for c in tie],
    )
    both = sch.unionByName(obs)
    # first observation at or after each due time
    nxt = F.when(F.col("_kind") == 1, F.struct(F.col("_t").alias("t"), F.col("_s").alias("s")))
    aligned = look(both, ["_d"], epoch_micros(both, "_t"), nxt, "_next", ["_kind", *(["_o"] if tie else [])], ahead=True).where("_kind = 0")
    decided = aligned.withColumn(
        "_decisive", F.col("_next").isNull() | (F.col("_next.s") != F.lit(NXDOMAIN))
    )
    per = decided.groupBy("_d", "miss_at").agg(
        F.min_by(F.struct("attempt", "_next"), F.when(F.col("_decisive"), F.col("attempt"))).alias("_first"),
        F.count(F.lit(1)).alias("_n"),
    )
    first = F.col("_first")
    outcome = (
        F.when(first.isNull() | first.getField("attempt").isNull(), F.lit("gave_up"))
        .when(first.getField("_next").isNull(), F.lit("pending"))
        .when(first.getField("_next").getField("s") == F.lit(SUCCESS), F.lit("resolved"))
        .otherwise(F.lit("gave_up"))
    )
    return per.select(
        F.col("_d").alias(domain),
        "miss_at",
        outcome.alias("outcome"),
        F.when(outcome == "resolved", first.getField("attempt")).alias("attempt"),
        F.when(outcome == "resolved", first.getField("_next").getField("t")).alias("resolved_at"),
    )
