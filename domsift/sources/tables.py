"""Feed, DNS answers and ASN ranges derived from the driver's tables.

No domain feed or DNS data ship with the tables, so both sides are derived
by plain arithmetic that a SQL oracle can repeat exactly:

* names: host part of ``pages.url``;
* feed: every ``events`` row names the page ``event_id % #pages`` and is
  seen at ``ts``;
* DNS observations: every ``events`` row is also one observation of the
  page ``user_id % #pages``, its outcome chosen by ``event_type``/``value``;
  addresses are ``(user_id * 2654435761 + event_id + k * 65537) % M`` with
  ``M = 2^21 * #suppliers``;
* ASN ranges: supplier ``k`` owns ``[k * 2^20, k * 2^20 + 3 * 2^19 - 1]``
  (neighbours overlap, later rows win), named ``s_name``, country
  ``n_name``.

All of it grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from domsift.functions.ip import ipv4_text, key_from_ipv4_int

# Fixed values of the derivation (shared with the SQL oracle).
HOST_PATTERN = r"^https?://([^/:?#]+)"
IP_MULT = 2654435761
IP_STEP = 65537
RANGE_SHIFT = 1048576  # 2^20
RANGE_WIDTH = 3 * 524288  # 1.5 * 2^20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(page_id, domain)``."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", HOST_PATTERN, 1).alias("domain"))


def _n_pages(spark: SparkSession, sf_dir: str) -> Column:
    """Row count of ``pages`` (one number; parquet answers it from footers)."""
    return F.lit(table(spark, sf_dir, "pages").count()).cast("bigint")


def _n_suppliers(spark: SparkSession, sf_dir: str) -> Column:
    return F.lit(table(spark, sf_dir, "supplier").count()).cast("bigint")


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(event_id, seen_at, domain, user_id, event_type, value)``."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    pg = hosts(spark, sf_dir)
    joined = ev.join(pg, pg["page_id"] == F.pmod(ev["event_id"], _n_pages(spark, sf_dir)))
    return joined.select("event_id", F.col("ts").alias("seen_at"), "domain", "user_id", "event_type", "value")


def dns_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``dns_obs``: ``(event_id, domain, observed_at, ns_error, a_error, aaaa_error, ns, a, aaaa, latency_s)``."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    pg = hosts(spark, sf_dir)
    j = ev.join(pg, pg["page_id"] == F.pmod(ev["user_id"], _n_pages(spark, sf_dir)))
    m = F.lit(2097152) * _n_suppliers(spark, sf_dir)
    base = F.pmod(F.col("user_id") * F.lit(IP_MULT) + F.col("event_id"), m)
    n_a = F.pmod(F.col("event_id"), F.lit(3)) + 1
    a_list = F.slice(F.array(*[ipv4_text(F.pmod(base + F.lit(k * IP_STEP), m)) for k in range(3)]), F.lit(1), n_a.cast("int"))
    aaaa_list = F.when(
        F.col("event_type") == "click",
        F.array(F.concat(F.lit("2001:db8::"), F.lower(F.hex(F.pmod(F.col("event_id"), F.lit(65536)))))),
    ).otherwise(F.array().cast("array<string>"))
    et, v = F.col("event_type"), F.col("value")
    nx_ns = (et == "error") & (v < 50)
    fail_ns = (et == "error") & (v >= 50)
    timeout = et == "signup"
    servfail = (et == "purchase") & (v > 200)
    empty = (et == "view") & (v < 5)
    ok = ~(nx_ns | fail_ns | timeout | servfail | empty)
    empty_arr = F.array().cast("array<string>")
    return j.select(
        "event_id",
        "domain",
        F.col("ts").alias("observed_at"),
        F.when(nx_ns, F.lit("no record found: NXDOMAIN")).when(fail_ns, F.lit("connection refused")).alias("ns_error"),
        F.when(timeout, F.lit("operation timeout")).when(servfail, F.lit("SERVFAIL")).alias("a_error"),
        F.when(timeout, F.lit("operation timeout")).alias("aaaa_error"),
        F.when(nx_ns | fail_ns, empty_arr).otherwise(F.array(F.concat(F.lit("ns1."), F.col("domain")))).alias("ns"),
        F.when(ok, a_list).otherwise(empty_arr).alias("a"),
        F.when(ok, aaaa_list).otherwise(empty_arr).alias("aaaa"),
        F.round(v / 100, 4).alias("latency_s"),
    )


def asn_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(ver, lo, hi, as_number, as_name, country_code, row_ord)`` - overlapping on purpose."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"])  # 25 nations
    lo = F.col("s_suppkey") * F.lit(RANGE_SHIFT)
    return j.select(
        F.lit(4).cast("tinyint").alias("ver"),
        key_from_ipv4_int(lo).alias("lo"),
        key_from_ipv4_int(lo + F.lit(RANGE_WIDTH - 1)).alias("hi"),
        F.col("s_suppkey").alias("as_number"),
        F.col("s_name").alias("as_name"),
        F.col("n_name").alias("country_code"),
        F.col("s_suppkey").alias("row_ord"),
    )


# A small public-suffix table for the tests (plain, wildcard, exception).
SUFFIX_RULES = ["com", "net", "org", "example.com", "example.net", "*.example.org", "!spam-farm.example.org"]


def suffix_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r,) for r in SUFFIX_RULES], "rule STRING")
