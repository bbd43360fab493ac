"""Joining names to DNS answers and building alert records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domsift.functions.dns import is_success
from domsift.operators.dedup import epoch_micros
from domsift.operators.scan import BUCKET_SECONDS, join_null_safe, look
from domsift.operators.store import stored

ENRICHMENT_TYPE = "array<struct<ip:string,as_number:bigint,as_name:string,country_code:string>>"


def dns_snapshot(dns: DataFrame, domain: str = "domain", ts: str = "observed_at", order: str | None = None) -> DataFrame:
    """Latest successful answer per name (the answer cache as a table).

    The latest time of each name is found first, by a hash aggregate of narrow
    rows; only the answers of that time are ranked as whole rows (whole rows of all
    answers would be sorted).
    """
    ok = dns.where(is_success())
    latest = stored(ok.groupBy(domain).agg(F.max(ts).alias(ts)), "latest")
    ok = join_null_safe(ok, latest, [domain, ts], "inner")
    rank = F.struct(F.col(ts), *([F.col(order)] if order else []))
    others = [c for c in dns.columns if c != domain]
    agg = ok.groupBy(domain).agg(F.max_by(F.struct(*[F.col(c) for c in others]), rank).alias("_o"))
    return agg.select(domain, *[F.col("_o").getField(c).alias(c) for c in others])


def attach_dns(feed: DataFrame, dns: DataFrame, domain: str = "domain") -> DataFrame:
    """Inner equi-join of names with their answers: unresolved names leave the pipeline."""
    return feed.join(dns, domain, "inner")


def attach_dns_within(
    feed: DataFrame, dns: DataFrame, horizon_seconds: float, domain: str = "domain", seen: str = "seen_at",
    observed: str = "observed_at", order: str | None = None, bucket_seconds: float = BUCKET_SECONDS,
) -> DataFrame:
    """Each name seen with its first successful answer from then on, at most ``horizon_seconds`` later.

    Names without such an answer leave the pipeline; an answer from before the
    name was seen doesn't count. Answers of equal time go by ``order``. Names and
    answers are put in one line per name and looked along in time buckets, so no
    pairs of a name's rows with a name's answers are formed. Adds the answer's
    columns; names that both sides have must be renamed before.
    """
    added = [c for c in dns.columns if c != domain]
    taken = set(added) & set(feed.columns)
    if taken:
        raise ValueError(f"both sides have columns {sorted(taken)}")
    answers = dns.where(is_success())
    ask = feed.select(
        F.col(domain).alias("_d"), epoch_micros(feed, seen).alias("_at"), F.lit(0).alias("_kind"), F.struct(*feed.columns).alias("_row"),
        F.lit(None).cast(answers.select(F.struct(*added).alias("s")).schema["s"].dataType).alias("_answer"),
        F.lit(None).cast(dns.schema[order].dataType if order else "int").alias("_o"),
    )
    told = answers.select(
        F.col(domain).alias("_d"), epoch_micros(dns, observed).alias("_at"), F.lit(1).alias("_kind"),
        F.lit(None).cast(ask.schema["_row"].dataType).alias("_row"), F.struct(*added).alias("_answer"),
        (F.col(order) if order else F.lit(None).cast("int")).alias("_o"),
    )
    both = ask.unionByName(told).where("_at is not null")
    met = F.when(F.col("_kind") == 1, F.struct(F.col("_at").alias("at"), F.col("_answer").alias("answer")))
    looked = look(both, ["_d"], F.col("_at"), met, "_next", ["_kind", "_o"], ahead=True, bucket_seconds=bucket_seconds)
    within = F.col("_next.at") - F.col("_at") <= F.lit(int(round(horizon_seconds * 1_000_000)))
    return looked.where((F.col("_kind") == 0) & F.col("_d").isNotNull() & within).select("_row.*", "_next.answer.*")


def build_alerts(df: DataFrame, ts: str = "seen_at", first_resolution: str | None = None) -> DataFrame:
    """Project the alert record: ``timestamp, domain, source_tag, resolved_after_nxdomain, dns, enrichment``.

    A row whose enrichment failed (``enrichment`` null while the name has
    addresses) is dropped, as one failed address lookup drops the alert.
    """
    a = F.coalesce(F.col("a"), F.array().cast("array<string>"))
    aaaa = F.coalesce(F.col("aaaa"), F.array().cast("array<string>"))
    ns = F.coalesce(F.col("ns"), F.array().cast("array<string>"))
    fr = F.col(first_resolution) if first_resolution else F.lit(False)
    keep = [c for c in df.columns if c not in ("a", "aaaa", "ns", "enrichment", first_resolution)]
    out = df.select(
        *keep,
        F.col(ts).alias("timestamp") if ts != "timestamp" else F.col(ts),
        fr.alias("resolved_after_nxdomain"),
        F.struct(a.alias("a_records"), aaaa.alias("aaaa_records"), ns.alias("ns_records")).alias("dns"),
        F.coalesce(F.col("enrichment"), F.when(F.size(a) + F.size(aaaa) == 0, F.array().cast(ENRICHMENT_TYPE))).alias(
            "enrichment"
        ),
    )
    if ts != "timestamp" and ts in out.columns:
        out = out.drop(ts)
    return out.where(F.col("enrichment").isNotNull())


def union_alerts(*alerts: DataFrame) -> DataFrame:
    """Standard and first-resolution alerts in one table."""
    out = alerts[0]
    for a in alerts[1:]:
        out = out.unionByName(a, allowMissingColumns=True)
    return out
