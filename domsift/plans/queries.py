"""Registered queries over the driver's tables, each with a DuckDB oracle.

Every query reads whole tables (or data Spark derives from them, see
``domsift.sources.tables``); computed columns carry the same names as in
the oracle SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domsift.functions.dns import dns_status
from domsift.functions.ip import ip_key
from domsift.functions.text import alert_json, format_plain, rfc3339
from domsift.operators import dedup, digest, dns, feed as feed_ops, flush, metrics, ranges, rules, sketch, suffix
from domsift.operators.alerts import attach_dns_within, build_alerts, dns_snapshot
from domsift.operators.rule_index import match_rules_indexed
from domsift.operators.store import stored
from domsift.plans.detect import detect
from domsift.sources import tables
from domsift.sources.feed import parse_messages
from domsift.sources.rules import pattern_lines, rules_from_yaml_text

# The rule files used by the registered queries.
NAME_RULES_YAML = r"""
ignore:
  - '^m\.'
  - 'cheap-pills'
rules:
  - name: blog
    all:
      - domain_regex: '^blog\.'
  - name: mobile
    any:
      - domain_regex: '^m\.'
      - domain_regex: '^mobile\.'
  - name: pharma
    domain_regex: 'pills|pharma'
  - name: th-net
    all:
      - domain_regex: '\.net$'
      - domain_regex: '^(www\.)?th'
  - name: spam
    domain_regex: 'spam'
"""

ENRICHED_RULES_YAML = NAME_RULES_YAML + r"""
  - name: low-asn
    asns: [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]
  - name: com-elsewhere
    all:
      - domain_regex: '\.com$'
      - not_asns: [1, 2, 3, 4, 5]
  - name: www-block
    all:
      - domain_regex: '^www\.'
      - ip_networks: ['0.16.0.0/12']
  - name: no-doc-v6
    all:
      - domain_regex: 'ththe'
      - not_ip_networks: ['2001:db8::/32']
"""

IGNORE_PATTERNS = [r"^www\.", "spam-farm", r"\.example\.org$"]
SUPPRESS_TTL_S = 86400
DIGEST_WIDTH_S = 21600
FIRST_RESOLUTION_S = 43200
#: How long after a name is seen its answer still counts (the derived observations are sparse).
ANSWER_HORIZON_S = 21600
DIGEST_BATCH = 50
#: Different domains that send a digest at once (the derived alerts have few).
FLUSH_SIZE = 6


def name_rules() -> rules.RuleSet:
    return rules_from_yaml_text(NAME_RULES_YAML, "names.yml")


def enriched_rules() -> rules.RuleSet:
    return rules_from_yaml_text(ENRICHED_RULES_YAML, "enriched.yml")


# ---------------------------------------------------------------- Spark side


def q_feed_parse(spark: SparkSession, d: str) -> DataFrame:
    f = tables.feed(spark, d)
    day = F.to_date(F.col("seen_at")).alias("day")
    good = f.where(~F.col("event_type").isin("error", "signup"))
    msgs = good.groupBy("user_id", day).agg(
        F.to_json(F.struct(F.collect_list("domain").alias("data"))).alias("value")
    )
    junk = f.where(F.col("event_type").isin("error", "signup")).select(
        "user_id",
        day,
        F.when(F.col("event_type") == "error", F.concat(F.lit('{"message_type": "'), F.col("event_type"), F.lit('"}')))
        .otherwise(F.concat(F.lit('{"data": ['), F.col("event_id").cast("string"), F.lit("]}")))
        .alias("value"),
    )
    return parse_messages(msgs.unionByName(junk), "value").select("user_id", "day", "domain")


def q_feed_ignore(spark: SparkSession, d: str) -> DataFrame:
    return rules.ignore_filter(tables.feed(spark, d), IGNORE_PATTERNS).select("event_id", "domain")


def q_sample_repeatable(spark: SparkSession, d: str) -> DataFrame:
    return feed_ops.sample_repeatable(tables.feed(spark, d), "event_id", 0.25).select("event_id", "domain")


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    return rules.match_rules(tables.feed(spark, d), name_rules())


def q_rule_tags(spark: SparkSession, d: str) -> DataFrame:
    return _tagged(spark, d).select("event_id", "domain", F.array_join("source_tag", ",").alias("tags"))


def q_rule_counts(spark: SparkSession, d: str) -> DataFrame:
    return rules.rule_match_counts(_tagged(spark, d))


def q_match_rules_table(spark: SparkSession, d: str) -> DataFrame:
    rt = rules.rules_frame(spark, name_rules())
    return rules.match_rules_table(tables.feed(spark, d), rt).select("event_id", "rule_name")


def _customer_rules(spark: SparkSession, d: str) -> DataFrame:
    """A rule tree for each customer: three letters by its key, anywhere, or spread over the start and a later place."""
    k = F.col("c_custkey")
    letter = lambda n: F.chr(97 + F.pmod(F.floor(k / F.lit(n)), F.lit(26)))
    leaf = lambda *parts: F.concat(F.lit('{"domain_regex": "'), *[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit('"}'))
    three = F.concat(letter(1), letter(26), letter(676))
    both = F.concat(F.lit('{"all": ['), leaf("^", letter(1)), F.lit(", "), leaf(letter(26), ".*", letter(676), r"\\.[a-z]+$"), F.lit("]}"))
    either = F.concat(F.lit('{"any": ['), leaf(three), F.lit(", "), both, F.lit("]}"))
    return tables.table(spark, d, "customer").select(
        F.lit("customers").alias("file"), k.cast("int").alias("ord"), F.concat(F.lit("c"), k.cast("string")).alias("name"), either.alias("expr_json")
    )


def q_match_rules_indexed(spark: SparkSession, d: str) -> DataFrame:
    """Each name's sightings are summed up before it meets the rules: the pairs are of names and rules, not of rows."""
    names = tables.feed(spark, d).groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id"))
    out = match_rules_indexed(names, _customer_rules(spark, d))
    return out.groupBy("domain", "rule_name").agg(F.sum("n").alias("n"), F.max("last_id").alias("last_id"))


def q_ignored_names(spark: SparkSession, d: str) -> DataFrame:
    deny = tables.hosts(spark, d).where(F.col("domain").startswith("www.")).select("domain")
    return feed_ops.ignored_names(tables.feed(spark, d), deny).select("event_id", "domain")


def _benchmark_rules(spark: SparkSession, d: str) -> DataFrame:
    return pattern_lines(tables.table(spark, d, "benchmark"), "item_id", "text")


def q_patterns_to_rules(spark: SparkSession, d: str) -> DataFrame:
    return _benchmark_rules(spark, d)


def q_rule_file_stats(spark: SparkSession, d: str) -> DataFrame:
    return rules.rule_file_stats(_benchmark_rules(spark, d).withColumnRenamed("name", "file"))


def q_range_normalise(spark: SparkSession, d: str) -> DataFrame:
    norm = ranges.normalise_ranges(tables.asn_ranges(spark, d))
    return norm.select(
        F.col("ver").cast("int").alias("ver"),
        F.lower(F.hex("lo")).alias("lo_hex"),
        F.lower(F.hex("hi")).alias("hi_hex"),
        "as_number",
        "as_name",
        "country_code",
    )


def q_asn_join(spark: SparkSession, d: str) -> DataFrame:
    obs = tables.dns_observations(spark, d)
    pts = obs.select("event_id", F.posexplode(F.concat("a", "aaaa")).alias("pos", "ip"))
    return ranges.enrich_ips(pts, tables.asn_ranges(spark, d)).select(
        "event_id", "pos", "ip", "as_number", "as_name", "country_code"
    )


def q_asn_join_sweep(spark: SparkSession, d: str) -> DataFrame:
    """``asn_join`` as it runs where the ranges are too large to broadcast."""
    pts = tables.dns_observations(spark, d).select("event_id", F.posexplode(F.concat("a", "aaaa")).alias("pos", "ip"))
    out = ranges.enrich_ips(pts, tables.asn_ranges(spark, d), broadcast=False)
    return out.select("event_id", "pos", "ip", "as_number", "as_name", "country_code")


def q_asn_docs(spark: SparkSession, d: str) -> DataFrame:
    docs = tables.table(spark, d, "documents").select("doc_id", "text")
    found = docs.select(
        "doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"\b((?:[0-9]{1,3}\.){3}[0-9]{1,3})\b"), F.lit(1))).alias("pos", "ip")
    )
    return ranges.enrich_ips(found, tables.asn_ranges(spark, d)).select(
        "doc_id", "pos", "ip", ip_key("ip").isNotNull().alias("valid"), "as_number", "country_code"
    )


def _enrichment_text(col: str = "enrichment"):
    return F.array_join(
        F.transform(
            col,
            lambda e: F.concat_ws(
                "=",
                e.getField("ip"),
                F.concat_ws(
                    "/",
                    F.coalesce(e.getField("as_number").cast("string"), F.lit("-")),
                    F.coalesce(e.getField("as_name"), F.lit("-")),
                    F.coalesce(e.getField("country_code"), F.lit("-")),
                ),
            ),
        ),
        ";",
    )


def q_asn_enrich_nested(spark: SparkSession, d: str) -> DataFrame:
    obs = tables.dns_observations(spark, d)
    enr = ranges.enrich_dns_table(obs, tables.asn_ranges(spark, d), row_keys=("event_id",))
    return enr.select("event_id", _enrichment_text().alias("enrichment_text"))


def q_registrable_domain(spark: SparkSession, d: str) -> DataFrame:
    return suffix.registrable_domains(tables.hosts(spark, d), tables.suffix_rules(spark))


def _alerts_with_keys(spark: SparkSession, d: str) -> DataFrame:
    tagged = _tagged(spark, d)
    based = suffix.registrable_domain(tagged, tables.suffix_rules(spark))
    return based.withColumn(
        "dedup_key", dedup.dedup_key(base="base_domain", domain="domain", tags="source_tag", first_resolution=F.lit(False))
    )


def q_suppress_repeats(spark: SparkSession, d: str) -> DataFrame:
    flagged = dedup.suppress_repeats(_alerts_with_keys(spark, d), "dedup_key", "seen_at", SUPPRESS_TTL_S, order="event_id")
    return flagged.where("passed").select("event_id", "domain", "seen_at", "dedup_key")


def q_dns_status(spark: SparkSession, d: str) -> DataFrame:
    return dns.with_status(tables.dns_observations(spark, d)).select("event_id", "status", "error")


def q_dns_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return metrics.dns_status_counts(dns.with_status(tables.dns_observations(spark, d)))


def q_dns_latency(spark: SparkSession, d: str) -> DataFrame:
    return metrics.dns_latency_summary(dns.with_status(tables.dns_observations(spark, d)), exact=True)


def q_dns_latency_sketch(spark: SparkSession, d: str) -> DataFrame:
    """Sketches of each hour and status, merged by status."""
    hour = F.window("observed_at", "1 hour").getField("start").alias("hour")
    hourly = sketch.quantile_sketch(dns.with_status(tables.dns_observations(spark, d)), [hour, "status"], "latency_s")
    return sketch.sketch_quantiles(sketch.merge_sketches(hourly, ["status"]), ["status"]).select(
        "status", "n", *[F.round(c, 6).alias(c) for c in ("p50", "p90", "p95", "p99")]
    )


def _checks(spark: SparkSession, d: str) -> DataFrame:
    ev = tables.table(spark, d, "events")
    return ev.select(
        "event_id",
        F.concat(F.lit("r"), F.pmod("user_id", F.lit(7)).cast("string")).alias("resolver"),
        "ts",
        (F.col("event_type") != "error").alias("ok"),
    )


def q_health_transitions(spark: SparkSession, d: str) -> DataFrame:
    return dns.health_transitions(_checks(spark, d), "resolver", "ts", "ok", order="event_id").select(
        "event_id", "resolver", "healthy", "event"
    )


def q_failure_rate(spark: SparkSession, d: str) -> DataFrame:
    c = _checks(spark, d).withColumn("failed", ~F.col("ok"))
    return dns.failure_rate(c, "resolver", "ts", "failed", window_seconds=3600, threshold=0.5).select(
        "event_id", "checks", "failures", "failure_rate", "alarm"
    )


def _obs_status(spark: SparkSession, d: str) -> DataFrame:
    return dns.with_status(tables.dns_observations(spark, d))


def _first_resolutions(spark: SparkSession, d: str) -> DataFrame:
    fr = dns.first_resolution(_obs_status(spark, d), order="event_id", horizon_seconds=FIRST_RESOLUTION_S)
    return fr.where("resolved_after_nxdomain").select("event_id", "domain", "observed_at", "resolved_after_nxdomain")


def q_first_resolution(spark: SparkSession, d: str) -> DataFrame:
    return _first_resolutions(spark, d).drop("resolved_after_nxdomain")


def q_retry_schedule(spark: SparkSession, d: str) -> DataFrame:
    return dns.retry_schedule(_obs_status(spark, d)).select("event_id", "status", "attempt", "due_at")


def q_retry_outcome(spark: SparkSession, d: str) -> DataFrame:
    return dns.retry_outcome(_obs_status(spark, d), order="event_id")


def q_attach_dns_within(spark: SparkSession, d: str) -> DataFrame:
    answers = tables.dns_observations(spark, d).withColumnRenamed("event_id", "answer_id")
    met = attach_dns_within(tables.feed(spark, d), answers, ANSWER_HORIZON_S, order="answer_id")
    return met.select("event_id", "domain", "seen_at", "answer_id", "observed_at", F.array_join(F.concat("a", "aaaa"), ";").alias("ips"))


def q_rate_report(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rate_report(tables.feed(spark, d), "seen_at", "event_type", width_seconds=3600)


def _enriched_snapshot(spark: SparkSession, d: str) -> DataFrame:
    obs = tables.dns_observations(spark, d)
    snap = dns_snapshot(obs, order="event_id").withColumnRenamed("event_id", "dns_event_id")
    return ranges.enrich_dns_table(snap, tables.asn_ranges(spark, d), row_keys=("domain",))


def _alerts(spark: SparkSession, d: str) -> DataFrame:
    return detect(
        tables.feed(spark, d),
        _enriched_snapshot(spark, d),
        enriched_rules(),
        tables.suffix_rules(spark),
        ttl_seconds=None,
        apply_ignore=False,
    )


def q_alert_plain(spark: SparkSession, d: str) -> DataFrame:
    a = _alerts(spark, d)
    return a.select("event_id", format_plain(ts_text=F.concat(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+0000"))).alias("line"))


def q_alert_json(spark: SparkSession, d: str) -> DataFrame:
    return _alerts(spark, d).select("event_id", alert_json().alias("json"))


def q_digest_text(spark: SparkSession, d: str) -> DataFrame:
    a = _alerts(spark, d)
    return digest.digest_batches(a, "timestamp", DIGEST_WIDTH_S, batch_size=DIGEST_BATCH, order="event_id")


def q_digest_flush(spark: SparkSession, d: str) -> DataFrame:
    """Digests by size or tick, a channel for each rule."""
    a = _alerts(spark, d).withColumn("channel", F.explode("source_tag"))
    out = flush.digest_flush(a, "channel", "timestamp", DIGEST_WIDTH_S, FLUSH_SIZE, order="event_id")
    return out.select(
        "channel", "batch", F.unix_micros("flushed_at").alias("flushed_us"), "reason", "entries", F.array_join("groups", ",").alias("groups"),
        F.array_join(F.col("deduplicated").cast("array<string>"), ",").alias("deduplicated"), "text",
    )


def _passed(spark: SparkSession, d: str, answers: DataFrame) -> DataFrame:
    out = detect(
        tables.feed(spark, d),
        answers,
        enriched_rules(),
        tables.suffix_rules(spark),
        ttl_seconds=SUPPRESS_TTL_S,
        apply_ignore=True,
    )
    return out.select(
        "event_id", "domain", F.array_join("source_tag", ",").alias("tags"), "base_domain", rfc3339("timestamp").alias("ts_text")
    )


def q_pipeline_end_to_end(spark: SparkSession, d: str) -> DataFrame:
    return _passed(spark, d, _enriched_snapshot(spark, d))


def q_union_alerts(spark: SparkSession, d: str) -> DataFrame:
    from domsift.operators.alerts import union_alerts

    fr = detect(
        _first_resolutions(spark, d),
        _enriched_snapshot(spark, d),
        enriched_rules(),
        tables.suffix_rules(spark),
        ttl_seconds=None,
        apply_ignore=False,
        ts="observed_at",
        first_resolution="resolved_after_nxdomain",
    )
    both = union_alerts(
        _alerts(spark, d).withColumn("source", F.lit("feed")), fr.withColumn("source", F.lit("dns"))
    )
    return both.select(
        "source", "event_id", "domain", "resolved_after_nxdomain", F.array_join("source_tag", ",").alias("tags"),
        F.array_join(F.concat("dns.a_records", "dns.aaaa_records"), ";").alias("ips"),
        _enrichment_text().alias("enrichment_text"), dedup.dedup_key().alias("dedup_key"),
    )


def q_pipeline_counts(spark: SparkSession, d: str) -> DataFrame:
    f = tables.feed(spark, d)
    rs = enriched_rules()
    kept = rules.ignore_filter(f, rs.ignore)
    answers = stored(_enriched_snapshot(spark, d), "snapshot")
    alerts = detect(f, answers, rs, tables.suffix_rules(spark), ttl_seconds=None, apply_ignore=True)
    passed = _passed(spark, d, answers)
    parts = metrics.pipeline_counts(f, kept=kept, alerts=alerts, passed=passed)
    out = None
    for stage, df in parts.items():
        one = df.select(F.lit(stage).alias("stage"), F.col("n"))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "feed_parse": q_feed_parse,
    "feed_ignore": q_feed_ignore,
    "sample_repeatable": q_sample_repeatable,
    "rule_tags": q_rule_tags,
    "rule_counts": q_rule_counts,
    "match_rules_table": q_match_rules_table,
    "match_rules_indexed": q_match_rules_indexed,
    "ignored_names": q_ignored_names,
    "patterns_to_rules": q_patterns_to_rules,
    "rule_file_stats": q_rule_file_stats,
    "range_normalise": q_range_normalise,
    "asn_join": q_asn_join,
    "asn_join_sweep": q_asn_join_sweep,
    "asn_docs": q_asn_docs,
    "asn_enrich_nested": q_asn_enrich_nested,
    "registrable_domain": q_registrable_domain,
    "suppress_repeats": q_suppress_repeats,
    "dns_status": q_dns_status,
    "dns_status_counts": q_dns_status_counts,
    "dns_latency": q_dns_latency,
    "dns_latency_sketch": q_dns_latency_sketch,
    "health_transitions": q_health_transitions,
    "failure_rate": q_failure_rate,
    "first_resolution": q_first_resolution,
    "retry_schedule": q_retry_schedule,
    "retry_outcome": q_retry_outcome,
    "attach_dns_within": q_attach_dns_within,
    "rate_report": q_rate_report,
    "alert_plain": q_alert_plain,
    "alert_json": q_alert_json,
    "digest_text": q_digest_text,
    "digest_flush": q_digest_flush,
    "pipeline_end_to_end": q_pipeline_end_to_end,
    "union_alerts": q_union_alerts,
    "pipeline_counts": q_pipeline_counts,
}
