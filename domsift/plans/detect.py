"""The feed-to-alert plan, with rule stages placed around the DNS join.

``ignore -> name-only rules and the necessary condition of the enrichment rules ->
join with the answers that match -> repeat suppression``. A rule asks about a name
and its answer only, never about the time a name was seen. So tags and registrable
domain are worked out once per answer, not once per feed row, and answers without a
tag leave before the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domsift.operators import dedup, rules, suffix
from domsift.operators.alerts import attach_dns, build_alerts
from domsift.operators.store import stored

ALERT_COLUMNS = ["timestamp", "domain", "source_tag", "resolved_after_nxdomain", "dns", "enrichment"]


def detect(
    feed: DataFrame,
    dns_answers: DataFrame,
    rule_set: rules.RuleSet,
    suffixes: DataFrame | None = None,
    ttl_seconds: float | None = 3600,
    apply_ignore: bool = True,
    ts: str = "seen_at",
    order: str | None = "event_id",
    first_resolution: str | None = None,
) -> DataFrame:
    """Alerts for a feed ``(…, domain, seen_at)`` and answers ``(domain, a, aaaa, ns, enrichment, …)``.

    Names with no answer give no alert.  ``first_resolution`` names a boolean
    column of the feed that marks first resolutions after NXDOMAIN; these
    alerts carry the flag and have repeat keys of their own.  With ``ttl_seconds`` the alerts
    are suppressed per repeat key (registrable domain + tags).
    """
    df = rules.ignore_filter(feed, rule_set.ignore) if apply_ignore else feed
    stage1 = rule_set.by_level(rules.NONE)
    stage2 = [r for r in rule_set.rules if r.level != rules.NONE]
    keep = F.size(rules.tags_column(stage1)) > 0
    if stage2:
        keep = keep | rules.prefilter_column(stage2)
    df = df.where(keep).drop("source_tag", "base_domain")
    tagged = tagged_answers(dns_answers, stage1 + stage2, suffixes)
    tagged = stored(tagged.withColumn("_answer", F.monotonically_increasing_id()), "answers")
    if ttl_seconds:
        # repeats are found on the key alone; what passes gets its answer
        flag = F.col(first_resolution) if first_resolution else F.lit(False)
        key = dedup.dedup_key(first_resolution=flag)
        keyed = attach_dns(df, tagged.select("domain", "_answer", "source_tag", "base_domain")).withColumn("dedup_key", key)
        passed = dedup.suppress_repeats(keyed, "dedup_key", ts, ttl_seconds, order=order).where("passed").drop("passed")
        joined = passed.join(tagged.select("_answer", "a", "aaaa", "ns", "enrichment"), "_answer")
    else:
        joined = attach_dns(df, tagged)
    alerts = build_alerts(joined.drop("_answer"), ts=ts, first_resolution=first_resolution)
    last = [c for c in ("source_tag", "base_domain", "dedup_key") if c in alerts.columns]
    return alerts.select(*[c for c in alerts.columns if c not in last], *last)


def tagged_answers(dns_answers: DataFrame, ordered: list[rules.Rule], suffixes: DataFrame | None = None) -> DataFrame:
    """Answers that any rule matches: ``domain, a, aaaa, ns, enrichment`` with ``source_tag`` and ``base_domain``.

    Answers whose address lookup failed give no alert and are left out.
    """
    answers = dns_answers.select("domain", "a", "aaaa", "ns", "enrichment")
    seen = answers.withColumn("_given", F.struct("a", "aaaa", "ns", "enrichment")).withColumn("timestamp", F.lit(None).cast("timestamp"))
    records = build_alerts(seen, ts="timestamp")
    tagged = records.withColumn("source_tag", rules.tags_column(ordered)).where(F.size("source_tag") > 0)
    if suffixes is not None:
        tagged = suffix.registrable_domain(tagged, suffixes)
    else:
        tagged = tagged.withColumn("base_domain", F.lit(None).cast("string"))
    return tagged.select("domain", "_given.*", "source_tag", "base_domain")
