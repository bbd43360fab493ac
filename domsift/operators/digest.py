"""Alert digests: one representative per registrable domain, sorted lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from domsift.functions.text import alert_json, digest_line_parts, format_digest_line

# The code fence around a digest, the default batch size and timer.
FENCE = "```"
DEFAULT_BATCH_SIZE = 50
DEFAULT_FLUSH_SECONDS = 300


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def group_key(base: str = "base_domain", domain: str = "domain") -> Column:
    """Registrable domain, falling back to the name itself."""
    return F.coalesce(F.col(base), F.col(domain))


def aggregate_alerts(
    df: DataFrame,
    by: list[str | Column],
    ts: str = "timestamp",
    order: str | None = None,
    base: str = "base_domain",
    domain: str = "domain",
) -> DataFrame:
    """Per group and registrable domain: the first alert and ``deduplicated_count``.

    ``min_by`` over ``(ts, order)`` is a partial aggregate, so a hot domain
    is combined map-side before the shuffle.
    """
    cols = [c for c in df.columns]
    rank = F.struct(F.col(ts), *([F.col(order)] if order else []))
    return df.groupBy(*by, group_key(base, domain).alias("_g")).agg(
        F.min_by(F.struct(*[F.col(c) for c in cols]), rank).alias("alert"),
        (F.count(F.lit(1)) - 1).cast("bigint").alias("deduplicated_count"),
        F.min(rank).alias("_first"),
    )


def digest_sort_key(alert: Column) -> Column:
    """(registrable domain nulls last, name case-folded, first AS name case-folded nulls last)."""
    first_e = F.try_element_at(alert.getField("enrichment"), F.lit(1))
    org = F.when(first_e.getField("as_number").isNotNull(), first_e.getField("as_name"))
    return F.struct(
        alert.getField("base_domain").isNull().alias("b_null"),
        alert.getField("base_domain").alias("b"),
        F.lower(alert.getField("domain")).alias("d"),
        org.isNull().alias("o_null"),
        F.lower(org).alias("o"),
    )


def digest_entry(ts: str = "timestamp") -> Column:
    """What a digest keeps of an alert: its domain, the line's place, the line around the count, the alert as JSON."""
    k = digest_sort_key(F.struct("domain", "base_domain", "enrichment"))
    parts = [F.coalesce(k.getField(c).cast("string"), F.lit("")) for c in ("b_null", "b", "d", "o_null", "o")]
    head, tail = digest_line_parts(base=group_key())
    return F.struct(
        group_key().alias("group"), F.array(*parts).alias("sort_key"), head.alias("head"), tail.alias("tail"),
        alert_json(timestamp=ts).alias("alert"),
    )


def digest_batches(
    df: DataFrame,
    ts: str = "timestamp",
    width_seconds: int = DEFAULT_FLUSH_SECONDS,
    batch_size: int | None = None,
    order: str | None = None,
    by: list[str] | None = None,
    formatter: Callable[..., Column] = format_digest_line,
) -> DataFrame:
    """Time-bucketed digests: ``(window_start, batch, entries, text)``.

    Alerts are grouped per tumbling window (the flush timer) and registrable
    domain; with ``batch_size`` the groups of a window are also cut into
    batches of at most that many domains in arrival order, which bounds the
    text of one digest.  Lines are sorted as in ``digest_sort_key`` and
    joined inside a code fence.  ``formatter`` makes the line: it takes the
    keywords of ``format_digest_line``.
    """
    by = list(by or [])
    win = F.window(F.col(ts), f"{width_seconds} seconds").getField("start").alias("window_start")
    agg = aggregate_alerts(df, by + [win], ts, order)
    if batch_size:
        w = Window.partitionBy(*by, "window_start").orderBy("_first")
        agg = agg.withColumn("batch", ((F.row_number().over(w) - 1) / batch_size).cast("bigint"))
    else:
        agg = agg.withColumn("batch", F.lit(0).cast("bigint"))
    a = F.col("alert")
    line = formatter(
        base=F.coalesce(a.getField("base_domain"), a.getField("domain")),
        count=F.col("deduplicated_count"),
        domain=a.getField("domain"),
        source_tag=a.getField("source_tag"),
        dns=a.getField("dns"),
        enrichment=a.getField("enrichment"),
    )
    lines = agg.select(*by, "window_start", "batch", digest_sort_key(a).alias("_k"), line.alias("_line"))
    out = lines.groupBy(*by, "window_start", "batch").agg(
        F.count(F.lit(1)).cast("bigint").alias("entries"),
        F.array_sort(F.collect_list(F.struct("_k", "_line"))).alias("_l"),
    )
    text = format_digest(F.transform("_l", lambda x: x.getField("_line")))
    return out.select(*by, "window_start", "batch", "entries", text.alias("text"))


def format_digest(lines_sorted: Column) -> Column:
    """Sorted lines -> fenced text; an empty batch gives an empty text."""
    return F.when(F.size(lines_sorted) == 0, F.lit("")).otherwise(
        F.concat(F.lit(FENCE + "\n"), F.array_join(lines_sorted, "\n"), F.lit("\n" + FENCE))
    )


def digest_payload(digests: DataFrame, text: str = "text") -> DataFrame:
    """The webhook body ``{"text": ...}`` for each digest."""
    return digests.withColumn("payload", F.to_json(F.struct(F.col(text).alias("text"))))
