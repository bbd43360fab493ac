"""DuckDB SQL for every registered query (the correctness oracle).

Written independently of the Spark code: RE2 regexes with the rule files'
own patterns, window functions, a recursive CTE for the greedy repeat
suppression and an ASOF join for retry alignment.
"""

from __future__ import annotations

IPV4_RE = r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]|[0-9])\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]|[0-9])\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]|[0-9])\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]|[0-9])$"

HOSTS = r"hosts AS (SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS domain FROM pages)"
FEED = """feed AS (SELECT e.event_id, e.ts AS seen_at, h.domain, e.user_id, e.event_type, e.value
  FROM events e JOIN hosts h ON h.page_id = e.event_id % (SELECT count(*) FROM pages))"""

_X = "((base + k * 65537) % m)"
DNS = f"""dns0 AS (SELECT e.event_id, h.domain, e.ts AS observed_at, e.event_type AS et, e.value AS v,
    2097152 * (SELECT count(*) FROM supplier) AS m,
    (e.user_id * 2654435761 + e.event_id) % (2097152 * (SELECT count(*) FROM supplier)) AS base
  FROM events e JOIN hosts h ON h.page_id = e.user_id % (SELECT count(*) FROM pages)),
dns AS (SELECT event_id, domain, observed_at,
    CASE WHEN et = 'error' AND v < 50 THEN 'no record found: NXDOMAIN' WHEN et = 'error' THEN 'connection refused' END AS ns_error,
    CASE WHEN et = 'signup' THEN 'operation timeout' WHEN et = 'purchase' AND v > 200 THEN 'SERVFAIL' END AS a_error,
    CASE WHEN et = 'signup' THEN 'operation timeout' END AS aaaa_error,
    CASE WHEN et = 'error' THEN []::VARCHAR[] ELSE ['ns1.' || domain] END AS ns,
    CASE WHEN ok THEN list_transform(range(event_id % 3 + 1), lambda k: concat_ws('.',
        (({_X} >> 24) & 255)::VARCHAR, (({_X} >> 16) & 255)::VARCHAR, (({_X} >> 8) & 255)::VARCHAR, ({_X} & 255)::VARCHAR))
      ELSE []::VARCHAR[] END AS a,
    CASE WHEN ok AND et = 'click' THEN ['2001:db8::' || lower(hex(event_id % 65536))] ELSE []::VARCHAR[] END AS aaaa,
    round(v / 100, 4) AS latency_s
  FROM (SELECT *, NOT (et IN ('error', 'signup') OR (et = 'purchase' AND v > 200) OR (et = 'view' AND v < 5)) AS ok FROM dns0) x),
dnss AS (SELECT *,
    CASE WHEN ns_error IS NOT NULL THEN
           CASE WHEN lower(ns_error) LIKE '%nxdomain%' OR lower(ns_error) LIKE '%no records found%' THEN 'nxdomain' ELSE 'failure' END
         WHEN len(a) + len(aaaa) > 0 THEN 'success'
         WHEN coalesce(a_error, aaaa_error) IS NOT NULL THEN
           CASE WHEN lower(coalesce(a_error, aaaa_error)) LIKE '%nxdomain%' OR lower(coalesce(a_error, aaaa_error)) LIKE '%no records found%' THEN 'nxdomain'
                WHEN lower(coalesce(a_error, aaaa_error)) LIKE '%timeout%' THEN 'timeout' ELSE 'failure' END
         ELSE 'nxdomain' END AS status,
    CASE WHEN ns_error IS NOT NULL THEN ns_error WHEN len(a) + len(aaaa) > 0 THEN NULL
         WHEN coalesce(a_error, aaaa_error) IS NOT NULL THEN coalesce(a_error, aaaa_error)
         ELSE 'No A or AAAA records found for ' || domain END AS error
  FROM dns)"""

RANGES = """ranges AS (SELECT s.s_suppkey AS as_number, s.s_name AS as_name, n.n_name AS country_code,
    s.s_suppkey * 1048576 AS lo, s.s_suppkey * 1048576 + 1572863 AS hi, s.s_suppkey AS row_ord
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey)"""


def _ipnum(col: str) -> str:
    return (
        f"CASE WHEN regexp_full_match({col}, '{IPV4_RE}') THEN "
        f"split_part({col}, '.', 1)::BIGINT * 16777216 + split_part({col}, '.', 2)::BIGINT * 65536 + "
        f"split_part({col}, '.', 3)::BIGINT * 256 + split_part({col}, '.', 4)::BIGINT END"
    )


def _lookup(points: str, keys: str) -> str:
    """Left interval join of ``points(keys.., ip)`` with ``ranges``; later rows win."""
    return f"""num AS (SELECT *, {_ipnum('ip')} AS n FROM {points}),
hit AS (SELECT {', '.join('p.' + k for k in keys.split(','))},
    arg_max(r.as_number, r.row_ord) AS as_number, arg_max(r.as_name, r.row_ord) AS as_name,
    arg_max(r.country_code, r.row_ord) AS country_code
  FROM num p JOIN ranges r ON p.n BETWEEN r.lo AND r.hi GROUP BY ALL),
looked AS (SELECT num.*, hit.as_number, hit.as_name, hit.country_code FROM num LEFT JOIN hit USING ({keys}))"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


NAME_TAGS = r"""list_filter([
    CASE WHEN regexp_matches(domain, '^blog\.') THEN 'blog' END,
    CASE WHEN regexp_matches(domain, '^m\.') OR regexp_matches(domain, '^mobile\.') THEN 'mobile' END,
    CASE WHEN regexp_matches(domain, 'pills|pharma') THEN 'pharma' END,
    CASE WHEN regexp_matches(domain, '\.net$') AND regexp_matches(domain, '^(www\.)?th') THEN 'th-net' END,
    CASE WHEN regexp_matches(domain, 'spam') THEN 'spam' END], lambda t: t IS NOT NULL)"""

TAGGED = f"""tagged AS (SELECT *, {NAME_TAGS} AS source_tag FROM feed),
tagged2 AS (SELECT * FROM tagged WHERE len(source_tag) > 0)"""

SUFFIX = r"""sfx(rule) AS (VALUES ('com'), ('net'), ('org'), ('example.com'), ('example.net'), ('*.example.org'), ('!spam-farm.example.org')),
rd_names AS (SELECT DISTINCT domain FROM hosts WHERE domain IS NOT NULL),
rd_parts AS (SELECT domain, string_split(domain, '.') AS l, len(string_split(domain, '.')) AS n FROM rd_names),
rd_cand AS (SELECT domain, n, i, array_to_string(l[i:], '.') AS s, array_to_string(l[i + 1:], '.') AS par
  FROM rd_parts, range(1, n + 1) r(i)),
rd_m AS (SELECT domain,
    max(CASE WHEN '!' || s IN (SELECT rule FROM sfx) THEN n - i END) AS exc_len,
    max(CASE WHEN s IN (SELECT rule FROM sfx) OR (n - i + 1 >= 2 AND '*.' || par IN (SELECT rule FROM sfx)) THEN n - i + 1 END) AS rule_len
  FROM rd_cand GROUP BY domain),
rd AS (SELECT p.domain, CASE WHEN p.n > coalesce(m.exc_len, m.rule_len, 1)
    THEN array_to_string(p.l[p.n - coalesce(m.exc_len, m.rule_len, 1):], '.') END AS base_domain
  FROM rd_parts p LEFT JOIN rd_m m USING (domain))"""

# Latest successful answer per name, enriched in address order.
SNAPSHOT = f"""snap AS (SELECT domain, arg_max(a, (observed_at, event_id)) AS a, arg_max(aaaa, (observed_at, event_id)) AS aaaa,
    arg_max(ns, (observed_at, event_id)) AS ns
  FROM dnss WHERE status = 'success' GROUP BY domain),
snap_pts AS (SELECT domain, i - 1 AS pos, (a || aaaa)[i] AS ip FROM snap, range(1, len(a || aaaa) + 1) r(i)),
{_lookup('snap_pts', 'domain,pos')},
snap_e AS (SELECT s.domain, s.a, s.aaaa, s.ns,
    list(struct_pack(pos := l.pos, ip := l.ip, as_number := l.as_number, as_name := l.as_name, country_code := l.country_code) ORDER BY l.pos)
      FILTER (WHERE l.pos IS NOT NULL) AS enr
  FROM snap s LEFT JOIN looked l USING (domain) GROUP BY ALL)"""


def _alerts(ignore: bool, feed: str = "feed", p: str = "") -> str:
    """CTEs up to ``{p}alerts`` from the rows of ``feed(event_id, seen_at, domain)``."""
    ign = r"WHERE NOT (regexp_matches(domain, '^m\.') OR regexp_matches(domain, 'cheap-pills'))" if ignore else ""
    return f"""{p}fz AS (SELECT * FROM {feed} {ign}),
{p}al0 AS (SELECT f.event_id, f.seen_at, f.domain, {NAME_TAGS.replace('domain', 'f.domain')} AS t1,
    s.a, s.aaaa, s.ns, coalesce(s.enr, []) AS enr
  FROM {p}fz f JOIN snap_e s ON s.domain = f.domain),
{p}al1 AS (SELECT *, list_filter([
    CASE WHEN list_bool_or(list_transform(enr, lambda e: coalesce(e.as_number BETWEEN 1 AND 10, false))) THEN 'low-asn' END,
    CASE WHEN regexp_matches(domain, '\\.com$') AND list_bool_or(list_transform(enr, lambda e: e.as_number IS NOT NULL))
         AND NOT coalesce(list_bool_or(list_transform(enr, lambda e: coalesce(e.as_number BETWEEN 1 AND 5, false))), false) THEN 'com-elsewhere' END,
    CASE WHEN regexp_matches(domain, '^www\\.') AND list_bool_or(list_transform(a, lambda x: {_ipnum('x')} BETWEEN 1048576 AND 2097151)) THEN 'www-block' END,
    CASE WHEN regexp_matches(domain, 'ththe') AND len(a) + len(aaaa) > 0
         AND NOT coalesce(list_bool_or(list_transform(aaaa, lambda x: starts_with(lower(x), '2001:db8:'))), false) THEN 'no-doc-v6' END
  ], lambda t: t IS NOT NULL) AS t2 FROM {p}al0),
{p}alerts AS (SELECT al.*, t1 || t2 AS source_tag, rd.base_domain FROM {p}al1 al LEFT JOIN rd USING (domain) WHERE len(t1 || t2) > 0)"""


RFC3339 = """strftime(seen_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime(seen_at, '%f') = '000000' THEN ''
  WHEN substr(strftime(seen_at, '%f'), 4, 3) = '000' THEN '.' || substr(strftime(seen_at, '%f'), 1, 3)
  ELSE '.' || strftime(seen_at, '%f') END || '+00:00'"""


def _suppress(src: str, ttl: int) -> str:
    return f"""rec AS (
  SELECT * FROM (SELECT dedup_key, event_id, seen_at FROM {src}
                 QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY seen_at, event_id) = 1)
  UNION ALL
  SELECT * FROM (SELECT k.dedup_key, k.event_id, k.seen_at FROM rec r JOIN {src} k
                   ON k.dedup_key = r.dedup_key AND k.seen_at >= r.seen_at + INTERVAL {ttl} SECOND
                 QUALIFY row_number() OVER (PARTITION BY k.dedup_key ORDER BY k.seen_at, k.event_id) = 1))"""


DIGEST_LINE = f"""'[' || array_to_string(source_tag, ', ') || '] <https://urlscan.io/search/#page.domain%3A' || b || '|' || domain || '>'
  || CASE WHEN cnt > 0 THEN ' (+' || cnt || ' more)' ELSE '' END
  || '(<https://www.shodan.io/search?query=hostname%3A' || b || '|shodan>|<https://www.virustotal.com/gui/domain/' || b || '|vt>)'
  || CASE WHEN len(ips) > 0 THEN ' | <https://urlscan.io/search/#page.ip%3A('
       || array_to_string(list_transform(CASE WHEN len(list_filter(ips, lambda x: regexp_full_match(x, '{IPV4_RE}'))) > 0
            THEN list_filter(ips, lambda x: regexp_full_match(x, '{IPV4_RE}'))[1:3] ELSE ips[1:3] END, lambda x: '%22' || x || '%22'), '%20OR%20')
       || ')|' || CASE WHEN len(ips) > 1 THEN ips[1] || ' (+' || (len(ips) - 1) || ' more)' ELSE ips[1] END
       || '> (<https://www.shodan.io/search?query=ip%3A' || ips[1] || '|shodan>|<https://www.virustotal.com/gui/ip-address/' || ips[1] || '|vt>)'
     ELSE '' END
  || CASE WHEN enr[1].as_number IS NOT NULL THEN ' @ ' || enr[1].as_number || '/' || enr[1].as_name || ', ' || coalesce(enr[1].country_code, '??')
          WHEN len(ips) > 0 THEN ' @ /?, ??' ELSE '' END"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["feed_parse"] = with_(HOSTS, FEED) + (
        "SELECT user_id, CAST(seen_at AS DATE) AS day, domain FROM feed WHERE event_type NOT IN ('error', 'signup')"
    )
    q["feed_ignore"] = with_(HOSTS, FEED) + (
        r"SELECT event_id, domain FROM feed WHERE NOT (regexp_matches(domain, '^www\.') OR "
        r"regexp_matches(domain, 'spam-farm') OR regexp_matches(domain, '\.example\.org$'))"
    )
    q["sample_repeatable"] = with_(HOSTS, FEED) + "SELECT event_id, domain FROM feed WHERE (event_id * 7919) % 1000 < 250"
    q["rule_tags"] = with_(HOSTS, FEED, TAGGED) + "SELECT event_id, domain, array_to_string(source_tag, ',') AS tags FROM tagged2"
    q["rule_counts"] = with_(HOSTS, FEED, TAGGED) + (
        "SELECT rule, count(*)::BIGINT AS matches FROM (SELECT unnest(source_tag) AS rule FROM tagged2) GROUP BY rule"
    )
    q["match_rules_table"] = with_(HOSTS, FEED) + (
        r"SELECT event_id, 'blog' AS rule_name FROM feed WHERE regexp_matches(domain, '^blog\.') UNION ALL "
        r"SELECT event_id, 'pharma' FROM feed WHERE regexp_matches(domain, 'pills|pharma') UNION ALL "
        r"SELECT event_id, 'spam' FROM feed WHERE regexp_matches(domain, 'spam') UNION ALL "
        r"SELECT event_id, 'mobile' FROM feed WHERE regexp_matches(domain, '^m\.') OR regexp_matches(domain, '^mobile\.') UNION ALL "
        r"SELECT event_id, 'th-net' FROM feed WHERE regexp_matches(domain, '\.net$') AND regexp_matches(domain, '^(www\.)?th')"
    )
    q["match_rules_indexed"] = with_(HOSTS, FEED) + (
        "SELECT f.domain, 'c' || c_custkey AS rule_name, f.n, f.last_id "
        "FROM (SELECT domain, count(*)::BIGINT AS n, max(event_id) AS last_id FROM feed GROUP BY domain) f, (SELECT c_custkey, "
        "chr((97 + c_custkey % 26)::INT) AS x, chr((97 + c_custkey // 26 % 26)::INT) AS y, chr((97 + c_custkey // 676 % 26)::INT) AS z FROM customer) c "
        r"WHERE contains(domain, x || y || z) OR (starts_with(domain, x) AND regexp_matches(domain, y || '.*' || z || '\.[a-z]+$'))"
    )
    q["ignored_names"] = with_(HOSTS, FEED) + (
        "SELECT event_id, domain FROM feed WHERE domain NOT IN (SELECT domain FROM hosts WHERE starts_with(domain, 'www.'))"
    )
    p2r = r"""p2r AS (SELECT CAST(item_id AS VARCHAR) AS name, i::BIGINT AS line_no, p AS pattern FROM (
    SELECT item_id, i, regexp_replace(string_split(text, chr(10))[i], '^\s+|\s+$', '', 'g') AS p
    FROM benchmark, range(1, len(string_split(text, chr(10))) + 1) r(i)) WHERE p <> '' AND NOT starts_with(p, '#'))"""
    q["patterns_to_rules"] = with_(p2r) + "SELECT name, line_no, pattern FROM p2r"
    q["rule_file_stats"] = with_(p2r) + (
        "SELECT name AS file, count(*)::BIGINT AS rules, (sum(count(*)) OVER ())::BIGINT AS total_rules, "
        "(count(*) OVER ())::BIGINT AS total_files FROM p2r GROUP BY name"
    )
    q["range_normalise"] = with_(
        RANGES,
        "b AS (SELECT lo AS p FROM ranges UNION SELECT hi + 1 FROM ranges)",
        "segs AS (SELECT p AS lo, lead(p) OVER (ORDER BY p) - 1 AS hi FROM b)",
        """win AS (SELECT s.lo, s.hi, arg_max(r.as_number, r.row_ord) AS as_number, arg_max(r.as_name, r.row_ord) AS as_name,
    arg_max(r.country_code, r.row_ord) AS country_code
  FROM segs s JOIN ranges r ON s.lo BETWEEN r.lo AND r.hi WHERE s.hi IS NOT NULL GROUP BY s.lo, s.hi)""",
        """fl AS (SELECT *, CASE WHEN lag(hi) OVER (PARTITION BY as_number, as_name, country_code ORDER BY lo) + 1 = lo THEN 0 ELSE 1 END AS nw FROM win)""",
        """isl AS (SELECT *, sum(nw) OVER (PARTITION BY as_number, as_name, country_code ORDER BY lo ROWS UNBOUNDED PRECEDING) AS g FROM fl)""",
    ) + (
        "SELECT 4 AS ver, lpad(lower(hex(min(lo))), 32, '0') AS lo_hex, lpad(lower(hex(max(hi))), 32, '0') AS hi_hex, "
        "as_number, as_name, country_code FROM isl GROUP BY as_number, as_name, country_code, g"
    )
    q["asn_join"] = with_(
        HOSTS, DNS, RANGES,
        "pts AS (SELECT event_id, (i - 1)::BIGINT AS pos, (a || aaaa)[i] AS ip FROM dns, range(1, len(a || aaaa) + 1) r(i))",
        _lookup("pts", "event_id,pos"),
    ) + "SELECT event_id, pos, ip, as_number, as_name, country_code FROM looked"
    q["asn_join_sweep"] = q["asn_join"]
    q["asn_docs"] = with_(
        RANGES,
        r"""found AS (SELECT doc_id, (i - 1)::BIGINT AS pos, l[i] AS ip FROM (
    SELECT doc_id, regexp_extract_all(text, '\b((?:[0-9]{1,3}\.){3}[0-9]{1,3})\b', 1) AS l FROM documents) d,
    range(1, len(l) + 1) r(i))""",
        _lookup("found", "doc_id,pos"),
    ) + f"SELECT doc_id, pos, ip, regexp_full_match(ip, '{IPV4_RE}') AS valid, as_number, country_code FROM looked"
    q["asn_enrich_nested"] = with_(
        HOSTS, DNS, RANGES,
        "pts AS (SELECT event_id, (i - 1)::BIGINT AS pos, (a || aaaa)[i] AS ip FROM dns, range(1, len(a || aaaa) + 1) r(i))",
        _lookup("pts", "event_id,pos"),
    ) + (
        "SELECT d.event_id, coalesce(string_agg(l.ip || '=' || coalesce(l.as_number::VARCHAR, '-') || '/' || coalesce(l.as_name, '-') "
        "|| '/' || coalesce(l.country_code, '-'), ';' ORDER BY l.pos), '') AS enrichment_text "
        "FROM dns d LEFT JOIN looked l USING (event_id) GROUP BY d.event_id"
    )
    q["registrable_domain"] = with_(HOSTS, SUFFIX) + "SELECT domain, base_domain FROM rd"
    keyed = """ak AS (SELECT t.event_id, t.domain, t.seen_at,
    sha256(coalesce(rd.base_domain, t.domain) || '|' || array_to_string(list_sort(t.source_tag), ',')) AS dedup_key
  FROM tagged2 t LEFT JOIN rd USING (domain))"""
    q["suppress_repeats"] = with_(HOSTS, FEED, TAGGED, SUFFIX, keyed, _suppress("ak", 86400)).replace(
        "WITH ", "WITH RECURSIVE ", 1
    ) + "SELECT ak.event_id, ak.domain, ak.seen_at, ak.dedup_key FROM rec JOIN ak USING (event_id)"
    q["dns_status"] = with_(HOSTS, DNS) + "SELECT event_id, status, error FROM dnss"
    q["dns_status_counts"] = with_(HOSTS, DNS) + "SELECT status, count(*)::BIGINT AS queries FROM dnss GROUP BY status"
    pct = ", ".join(
        f"list_sort(list(latency_s))[greatest(1, ceil({p} * count(*)))::BIGINT] AS p{int(p * 100)}" for p in (0.5, 0.9, 0.95, 0.99)
    )
    q["dns_latency"] = with_(HOSTS, DNS) + (
        f"SELECT status, count(*)::BIGINT AS n, round(sum(latency_s), 6) AS total_s, {pct} FROM dnss GROUP BY status"
    )
    # the exact nearest-rank value, then the middle of the 1 % bucket that holds it
    g = "(1.01 / 0.99)"
    mid = "round(CASE WHEN {p} <= 1e-9 THEN 0 ELSE pow({g}, ceil(ln({p}) / ln({g}))) * 2 / (1 + {g}) END, 6) AS {p}"
    q["dns_latency_sketch"] = with_(HOSTS, DNS, f"per AS (SELECT status, count(*)::BIGINT AS n, {pct} FROM dnss GROUP BY status)") + (
        "SELECT status, n, " + ", ".join(mid.format(p=p, g=g) for p in ("p50", "p90", "p95", "p99")) + " FROM per"
    )
    checks = "c AS (SELECT event_id, 'r' || (user_id % 7) AS resolver, ts, event_type <> 'error' AS ok FROM events)"
    q["health_transitions"] = with_(
        checks, "h AS (SELECT *, coalesce(lag(ok) OVER (PARTITION BY resolver ORDER BY ts, event_id), true) AS prev FROM c)"
    ) + (
        "SELECT event_id, resolver, ok AS healthy, CASE WHEN NOT ok AND prev THEN 'UNHEALTHY' "
        "WHEN NOT ok AND NOT prev THEN 'REMAINS_UNHEALTHY' WHEN ok AND NOT prev THEN 'RECOVERED' END AS event FROM h"
    )
    q["failure_rate"] = with_(
        checks,
        """r AS (SELECT event_id, count(*) OVER w AS n, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER w AS bad FROM c
  WINDOW w AS (PARTITION BY resolver ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW))""",
    ) + (
        "SELECT event_id, n::BIGINT AS checks, bad::BIGINT AS failures, round(bad / n, 6) AS failure_rate, "
        "(bad / n) >= 0.5 AS alarm FROM r"
    )
    # each miss finds its name's next success; it counts within the horizon
    first = """nextok AS (SELECT n.event_id AS miss, n.observed_at AS miss_at, s.domain, min((s.observed_at, s.event_id)) AS ok
  FROM dnss n JOIN dnss s ON s.domain = n.domain AND (s.observed_at, s.event_id) > (n.observed_at, n.event_id)
  WHERE n.status = 'nxdomain' AND s.status = 'success' GROUP BY ALL),
firsts AS (SELECT DISTINCT ok[2] AS event_id, ok[1] AS seen_at, domain FROM nextok WHERE ok[1] <= miss_at + INTERVAL 43200 SECOND)"""
    q["first_resolution"] = with_(HOSTS, DNS, first) + "SELECT event_id, domain, seen_at AS observed_at FROM firsts"
    q["retry_schedule"] = with_(HOSTS, DNS) + (
        "SELECT event_id, status, (i + 1)::BIGINT AS attempt, observed_at + to_microseconds(CAST(CASE WHEN status = 'nxdomain' "
        "THEN 10000 * (pow(2, i + 1) - 1) ELSE 500 * (pow(2, i) - 1) END * 1000 AS BIGINT)) AS due_at "
        "FROM dnss, range(0, CASE WHEN status = 'nxdomain' THEN 6 ELSE 4 END) r(i) WHERE status <> 'success'"
    )
    q["retry_outcome"] = with_(
        HOSTS, DNS,
        """starts AS (SELECT domain, observed_at AS miss_at FROM (SELECT *, lag(status) OVER (PARTITION BY domain ORDER BY observed_at, event_id) AS prev
  FROM dnss) WHERE status = 'nxdomain' AND coalesce(prev, '') <> 'nxdomain')""",
        """sched AS (SELECT domain, miss_at, (i + 1)::BIGINT AS attempt,
    miss_at + to_microseconds(CAST(10000 * (pow(2, i + 1) - 1) * 1000 AS BIGINT)) AS due_at FROM starts, range(0, 6) r(i))""",
        """al AS (SELECT s.*, o.observed_at AS nt, o.status AS ns FROM sched s ASOF LEFT JOIN dnss o
  ON s.domain = o.domain AND o.observed_at >= s.due_at)""",
        "dec AS (SELECT *, (nt IS NULL OR ns <> 'nxdomain') AS decisive FROM al)",
        "per AS (SELECT domain, miss_at, min(attempt) FILTER (WHERE decisive) AS fa FROM dec GROUP BY domain, miss_at)",
    ) + (
        "SELECT p.domain, p.miss_at, CASE WHEN p.fa IS NULL THEN 'gave_up' WHEN d.nt IS NULL THEN 'pending' "
        "WHEN d.ns = 'success' THEN 'resolved' ELSE 'gave_up' END AS outcome, "
        "CASE WHEN d.ns = 'success' THEN p.fa END AS attempt, CASE WHEN d.ns = 'success' THEN d.nt END AS resolved_at "
        "FROM per p LEFT JOIN dec d ON d.domain = p.domain AND d.miss_at = p.miss_at AND d.attempt = p.fa"
    )
    # one answer a name and time, then the first one from when the name was seen
    q["attach_dns_within"] = with_(
        HOSTS, FEED, DNS,
        """answers AS (SELECT * FROM dnss WHERE status = 'success'
  QUALIFY row_number() OVER (PARTITION BY domain, observed_at ORDER BY event_id) = 1)""",
        """met AS (SELECT f.event_id, f.domain, f.seen_at, s.event_id AS answer_id, s.observed_at, array_to_string(s.a || s.aaaa, ';') AS ips
  FROM feed f ASOF JOIN answers s ON f.domain = s.domain AND s.observed_at >= f.seen_at)""",
    ) + "SELECT * FROM met WHERE observed_at <= seen_at + INTERVAL 21600 SECOND"
    q["rate_report"] = with_(HOSTS, FEED) + (
        "SELECT time_bucket(INTERVAL '3600 seconds', seen_at) AS window_start, event_type, count(*)::BIGINT AS n, "
        "round(count(*) / 3600.0, 6) AS per_second FROM feed GROUP BY ALL"
    )
    base = [HOSTS, FEED, DNS, RANGES, SNAPSHOT, SUFFIX]
    plain = """'[' || array_to_string(source_tag, ', ') || '] ' || domain || ' -> ' || coalesce((a || aaaa)[1], '') || ' '
  || CASE WHEN len(a || aaaa) = 0 THEN '' WHEN enr[1].as_number IS NOT NULL
          THEN '[' || coalesce(enr[1].country_code, '??') || ', ' || enr[1].as_number || ', ' || enr[1].as_name || ']'
          ELSE '[No enrichment data]' END
  || CASE WHEN len(a || aaaa) > 1 THEN ' (+' || (len(a || aaaa) - 1) || ' other IPs)' ELSE '' END
  || ' [' || strftime(seen_at, '%Y-%m-%dT%H:%M:%S') || '+0000]'"""
    q["alert_plain"] = with_(*base, _alerts(False)) + f"SELECT event_id, trim({plain}) AS line FROM alerts"
    enr_json = """'[' || coalesce(array_to_string(list_transform(enr, lambda e: '{"ip":' || to_json(e.ip)
    || CASE WHEN e.as_number IS NOT NULL THEN ',"as_number":' || e.as_number || ',"as_name":' || to_json(e.as_name)
       || CASE WHEN e.country_code IS NOT NULL THEN ',"country_code":' || to_json(e.country_code) ELSE '' END ELSE '' END || '}'), ','), '') || ']'"""
    js = f"""'{{"timestamp":' || to_json({RFC3339}) || ',"domain":' || to_json(domain) || ',"source_tag":' || to_json(source_tag)
  || ',"resolved_after_nxdomain":false,"dns":{{"a_records":' || to_json(a) || ',"aaaa_records":' || to_json(aaaa)
  || ',"ns_records":' || to_json(ns) || '}},"enrichment":' || {enr_json} || '}}'"""
    q["alert_json"] = with_(*base, _alerts(False)) + f"SELECT event_id, {js} AS json FROM alerts"
    digest = [
        """grp AS (SELECT time_bucket(INTERVAL '21600 seconds', seen_at) AS window_start, coalesce(base_domain, domain) AS g,
    arg_min(event_id, (seen_at, event_id)) AS rep, (count(*) - 1)::BIGINT AS cnt, min((seen_at, event_id)) AS first
  FROM alerts GROUP BY ALL)""",
        """lines AS (SELECT g2.window_start, ((row_number() OVER (PARTITION BY g2.window_start ORDER BY g2.first) - 1) // 50)::BIGINT AS batch,
    a.*, coalesce(a.base_domain, a.domain) AS b, g2.cnt, a.a || a.aaaa AS ips
  FROM grp g2 JOIN alerts a ON a.event_id = g2.rep)""",
    ]
    order = (
        "base_domain IS NULL, base_domain, lower(domain), (enr[1].as_number IS NULL), "
        "lower(CASE WHEN enr[1].as_number IS NOT NULL THEN enr[1].as_name END), line"
    )
    q["digest_text"] = with_(*base, _alerts(False), *digest, f"ll AS (SELECT *, {DIGEST_LINE} AS line FROM lines)") + (
        f"SELECT window_start, batch, count(*)::BIGINT AS entries, "
        f"'```' || chr(10) || string_agg(line, chr(10) ORDER BY {order}) || chr(10) || '```' AS text "
        "FROM ll GROUP BY window_start, batch"
    )
    # row after row of each channel: what is pending, the next tick and the digest's number
    flush = [
        """rows_c AS MATERIALIZED (SELECT channel, event_id, epoch_us(seen_at) AS t, coalesce(base_domain, domain) AS g,
    row_number() OVER (PARTITION BY channel ORDER BY seen_at, event_id) AS pos
  FROM (SELECT *, unnest(source_tag) AS channel FROM alerts))""",
        """going AS (SELECT channel, event_id, g, t, pos, 0::BIGINT AS batch, t + 21600000000 AS tick, [g] AS pending, false AS cut FROM rows_c WHERE pos = 1
  UNION ALL
  SELECT channel, event_id, g, t, pos, CASE WHEN fresh THEN batch + 1 ELSE batch END,
    CASE WHEN t >= due THEN due + ((t - due) // 21600000000 + 1) * 21600000000 ELSE due END,
    CASE WHEN fresh THEN [g] WHEN list_contains(pending, g) THEN pending ELSE list_append(pending, g) END AS now,
    len(CASE WHEN fresh THEN [g] WHEN list_contains(pending, g) THEN pending ELSE list_append(pending, g) END) = 6
  FROM (SELECT r.*, w.batch, w.pending, CASE WHEN w.cut THEN w.t + 21600000000 ELSE w.tick END AS due, w.cut OR r.t >= w.tick AS fresh
    FROM going w JOIN rows_c r ON r.channel = w.channel AND r.pos = w.pos + 1))""",
        """due AS (SELECT channel, batch, coalesce(max(CASE WHEN cut THEN t END), max(tick)) AS flushed_us, CASE WHEN bool_or(cut) THEN 'size' ELSE 'tick' END AS reason
  FROM going GROUP BY ALL)""",
        """lines AS (SELECT p.channel, p.batch, p.pos, p.g, p.cnt, a.*, coalesce(a.base_domain, a.domain) AS b, a.a || a.aaaa AS ips
  FROM (SELECT channel, batch, g, min(pos) AS pos, arg_min(event_id, pos) AS rep, (count(*) - 1)::BIGINT AS cnt FROM going GROUP BY ALL) p
  JOIN alerts a ON a.event_id = p.rep)""",
        f"ll AS (SELECT *, {DIGEST_LINE} AS line FROM lines)",
    ]
    q["digest_flush"] = with_(*base, _alerts(False), *flush).replace("WITH ", "WITH RECURSIVE ", 1) + (
        f"SELECT channel, batch, flushed_us, reason, count(*)::BIGINT AS entries, string_agg(g, ',' ORDER BY pos) AS groups, "
        f"string_agg(cnt::VARCHAR, ',' ORDER BY pos) AS deduplicated, "
        f"'```' || chr(10) || string_agg(line, chr(10) ORDER BY {order}) || chr(10) || '```' AS text "
        "FROM ll JOIN due USING (channel, batch) GROUP BY channel, batch, flushed_us, reason"
    )
    e2e_keyed = """ak AS (SELECT event_id, seen_at, domain, source_tag, base_domain,
    sha256(coalesce(base_domain, domain) || '|' || array_to_string(list_sort(source_tag), ',')) AS dedup_key FROM alerts)"""
    q["pipeline_end_to_end"] = with_(*base, _alerts(True), e2e_keyed, _suppress("ak", 86400)).replace(
        "WITH ", "WITH RECURSIVE ", 1
    ) + (
        f"SELECT ak.event_id, ak.domain, array_to_string(ak.source_tag, ',') AS tags, ak.base_domain, "
        f"{RFC3339.replace('seen_at', 'ak.seen_at')} AS ts_text FROM rec JOIN ak USING (event_id)"
    )
    shown = """event_id, domain, {first} AS resolved_after_nxdomain, array_to_string(source_tag, ',') AS tags,
  array_to_string(a || aaaa, ';') AS ips, coalesce(array_to_string(list_transform(enr, lambda e: e.ip || '=' || coalesce(e.as_number::VARCHAR, '-')
    || '/' || coalesce(e.as_name, '-') || '/' || coalesce(e.country_code, '-')), ';'), '') AS enrichment_text, sha256({key}) AS dedup_key"""
    tags = "array_to_string(list_sort(source_tag), ',')"
    q["union_alerts"] = with_(*base, _alerts(False), first, _alerts(False, "firsts", "fr_")) + (
        "SELECT 'feed' AS source, " + shown.format(first="false", key=f"coalesce(base_domain, domain) || '|' || {tags}") + " FROM alerts UNION ALL "
        "SELECT 'dns', " + shown.format(first="true", key=f"domain || '::' || {tags} || '::FIRST_RESOLUTION'") + " FROM fr_alerts"
    )
    counts = with_(*base, _alerts(True), e2e_keyed, _suppress("ak", 86400)).replace("WITH ", "WITH RECURSIVE ", 1)
    q["pipeline_counts"] = counts + (
        "SELECT 'ingested' AS stage, count(*)::BIGINT AS n FROM feed UNION ALL "
        "SELECT 'kept', count(*)::BIGINT FROM fz UNION ALL "
        "SELECT 'alerts', count(*)::BIGINT FROM alerts UNION ALL "
        "SELECT 'passed', count(*)::BIGINT FROM rec"
    )
    return q
