"""Text renderings of alerts: JSON line, plain line, digest line, timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from domsift.functions.dns import all_ips
from domsift.functions.ip import IPV4_PATTERN

# Link templates of a digest line (search sites keyed on the
# registrable domain and on the first addresses), and the markers used in
# plain and digest lines.
URLSCAN_DOMAIN = "<https://urlscan.io/search/#page.domain%3A{base}|{domain}>"
SHODAN_VT_DOMAIN = (
    "(<https://www.shodan.io/search?query=hostname%3A{base}|shodan>"
    "|<https://www.virustotal.com/gui/domain/{base}|vt>)"
)
URLSCAN_IP = "<https://urlscan.io/search/#page.ip%3A({query})|{text}>"
SHODAN_VT_IP = (
    "(<https://www.shodan.io/search?query=ip%3A{ip}|shodan>"
    "|<https://www.virustotal.com/gui/ip-address/{ip}|vt>)"
)
IP_QUOTE = "%22"
IP_OR = "%20OR%20"
NO_COUNTRY = "??"
NO_ENRICHMENT = "[No enrichment data]"
NO_ASN = " @ /?, ??"
SEARCH_IP_LIMIT = 3


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _template(tpl: str, **parts: Column) -> Column:
    """Fill a '{name}' template with columns, as one concat."""
    pieces: list[Column] = []
    rest = tpl
    while rest:
        start = rest.find("{")
        if start < 0:
            pieces.append(F.lit(rest))
            break
        end = rest.index("}", start)
        if start:
            pieces.append(F.lit(rest[:start]))
        pieces.append(parts[rest[start + 1 : end]])
        rest = rest[end + 1 :]
    return F.concat(*pieces)


def rfc3339(ts: Column | str) -> Column:
    """UTC timestamp text with a +00:00 offset and 0/3/6 fraction digits."""
    t = F.to_utc_timestamp(_c(ts), F.current_timezone())  # printed by the session's clock
    frac = F.date_format(t, "SSSSSS")
    frac_txt = (
        F.when(frac == "000000", F.lit(""))
        .when(F.substring(frac, 4, 3) == "000", F.concat(F.lit("."), F.substring(frac, 1, 3)))
        .otherwise(F.concat(F.lit("."), frac))
    )
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), frac_txt, F.lit("+00:00"))


def tags_display(tags: Column | str = "source_tag") -> Column:
    return F.array_join(_c(tags), ", ")


def tags_key(tags: Column | str = "source_tag") -> Column:
    return F.array_join(F.array_sort(_c(tags)), ",")


def alert_struct(
    timestamp: Column | str = "timestamp",
    domain: Column | str = "domain",
    source_tag: Column | str = "source_tag",
    resolved_after_nxdomain: Column | str = "resolved_after_nxdomain",
    dns: Column | str = "dns",
    enrichment: Column | str = "enrichment",
) -> Column:
    """The alert record in its published field order; ASN fields flat per IP."""
    return F.struct(
        rfc3339(timestamp).alias("timestamp"),
        _c(domain).alias("domain"),
        _c(source_tag).alias("source_tag"),
        _c(resolved_after_nxdomain).alias("resolved_after_nxdomain"),
        _c(dns).alias("dns"),
        _c(enrichment).alias("enrichment"),
    )


def alert_json(**cols) -> Column:
    """One JSON object per alert; null fields are omitted, empty arrays kept."""
    return F.to_json(alert_struct(**cols))


def first_ip(dns: Column | str = "dns") -> Column:
    return F.try_element_at(all_ips(dns), F.lit(1))


def _asn_of(enrichment: Column, ip: Column) -> Column:
    """Enrichment entry for one IP (first one listed), or null."""
    return F.try_element_at(F.filter(enrichment, lambda e: e.getField("ip") == ip), F.lit(1))


def format_plain(
    ts_text: Column | None = None,
    domain: Column | str = "domain",
    source_tag: Column | str = "source_tag",
    dns: Column | str = "dns",
    enrichment: Column | str = "enrichment",
    timestamp: Column | str = "timestamp",
) -> Column:
    """`[tags] domain -> ip [CC, asn, name] (+n other IPs) [time]`, trimmed."""
    ips = all_ips(dns)
    fip = F.try_element_at(ips, F.lit(1))
    entry = _asn_of(_c(enrichment), fip)
    asn_txt = F.concat(
        F.lit("["),
        F.coalesce(entry.getField("country_code"), F.lit(NO_COUNTRY)),
        F.lit(", "),
        entry.getField("as_number").cast("string"),
        F.lit(", "),
        F.coalesce(entry.getField("as_name"), F.lit("")),
        F.lit("]"),
    )
    details = (
        F.when(fip.isNull(), F.lit(""))
        .when(entry.isNotNull() & entry.getField("as_number").isNotNull(), asn_txt)
        .otherwise(F.lit(NO_ENRICHMENT))
    )
    others = F.size(ips) - 1
    others_txt = F.when(others > 0, F.concat(F.lit(" (+"), others.cast("string"), F.lit(" other IPs)"))).otherwise(
        F.lit("")
    )
    when_txt = ts_text if ts_text is not None else F.date_format(_c(timestamp), "yyyy-MM-dd'T'HH:mm:ssZ")
    line = F.concat(
        F.lit("["),
        tags_display(source_tag),
        F.lit("] "),
        _c(domain),
        F.lit(" -> "),
        F.coalesce(fip, F.lit("")),
        F.lit(" "),
        details,
        others_txt,
        F.lit(" ["),
        when_txt,
        F.lit("]"),
    )
    return F.trim(line)


def digest_line_parts(
    base: Column | str = "base_domain",
    domain: Column | str = "domain",
    source_tag: Column | str = "source_tag",
    dns: Column | str = "dns",
    enrichment: Column | str = "enrichment",
) -> tuple[Column, Column]:
    """A digest line before and after its ` (+n more)`: tags and name link; lookups, IP links, ` @ asn/org, CC`."""
    b, d = _c(base), _c(domain)
    ips = all_ips(dns)
    v4 = F.filter(ips, lambda ip: ip.rlike(IPV4_PATTERN))
    search = F.when(F.size(v4) > 0, F.slice(v4, 1, SEARCH_IP_LIMIT)).otherwise(F.slice(ips, 1, SEARCH_IP_LIMIT))
    query = F.array_join(F.transform(search, lambda ip: F.concat(F.lit(IP_QUOTE), ip, F.lit(IP_QUOTE))), IP_OR)
    fip = F.try_element_at(ips, F.lit(1))
    link_text = F.when(
        F.size(ips) > 1, F.concat(fip, F.lit(" (+"), (F.size(ips) - 1).cast("string"), F.lit(" more)"))
    ).otherwise(fip)
    ip_part = F.when(
        F.size(ips) > 0,
        F.concat(
            F.lit(" | "),
            _template(URLSCAN_IP, query=query, text=link_text),
            F.lit(" "),
            _template(SHODAN_VT_IP, ip=fip),
        ),
    ).otherwise(F.lit(""))
    first_e = F.try_element_at(_c(enrichment), F.lit(1))
    enrich_part = (
        F.when(
            first_e.isNotNull() & first_e.getField("as_number").isNotNull(),
            F.concat(
                F.lit(" @ "),
                first_e.getField("as_number").cast("string"),
                F.lit("/"),
                F.coalesce(first_e.getField("as_name"), F.lit("")),
                F.lit(", "),
                F.coalesce(first_e.getField("country_code"), F.lit(NO_COUNTRY)),
            ),
        )
        .when(F.size(ips) > 0, F.lit(NO_ASN))
        .otherwise(F.lit(""))
    )
    head = F.concat(F.lit("["), tags_display(source_tag), F.lit("] "), _template(URLSCAN_DOMAIN, base=b, domain=d))
    return head, F.concat(_template(SHODAN_VT_DOMAIN, base=b), ip_part, enrich_part)


def format_digest_line(
    base: Column | str = "base_domain",
    count: Column | str = "deduplicated_count",
    domain: Column | str = "domain",
    source_tag: Column | str = "source_tag",
    dns: Column | str = "dns",
    enrichment: Column | str = "enrichment",
) -> Column:
    """One digest line: tags, domain links, IP links, ` @ asn/org, CC`."""
    n = _c(count)
    more = F.when(n > 0, F.concat(F.lit(" (+"), n.cast("string"), F.lit(" more)"))).otherwise(F.lit(""))
    head, tail = digest_line_parts(base, domain, source_tag, dns, enrichment)
    return F.concat(head, more, tail)
