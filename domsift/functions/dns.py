"""DNS-outcome expressions: status of one observation, address lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The four outcome labels.
SUCCESS, NXDOMAIN, TIMEOUT, FAILURE = "success", "nxdomain", "timeout", "failure"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def is_nxdomain(text: Column | str) -> Column:
    """Case-insensitive 'nxdomain' or 'no records found' in an error text."""
    low = F.lower(_c(text))
    return F.coalesce(low.contains("nxdomain") | low.contains("no records found"), F.lit(False))


def dns_status(
    ns_error: Column | str = "ns_error",
    a_error: Column | str = "a_error",
    aaaa_error: Column | str = "aaaa_error",
    a: Column | str = "a",
    aaaa: Column | str = "aaaa",
) -> Column:
    """Classify one observation into success / nxdomain / timeout / failure.

    NS error first (nxdomain or failure); then any A or AAAA address is a
    success even if the other family failed; then the first address-lookup
    error (A before AAAA); and empty answers without an error are nxdomain.
    """
    ns_e, a_e, aaaa_e = _c(ns_error), _c(a_error), _c(aaaa_error)
    n_ips = F.coalesce(F.size(_c(a)), F.lit(0)).cast("int")
    n_ips = F.greatest(n_ips, F.lit(0)) + F.greatest(F.coalesce(F.size(_c(aaaa)), F.lit(0)), F.lit(0))
    first_err = F.coalesce(a_e, aaaa_e)
    return (
        F.when(ns_e.isNotNull(), F.when(is_nxdomain(ns_e), F.lit(NXDOMAIN)).otherwise(F.lit(FAILURE)))
        .when(n_ips > 0, F.lit(SUCCESS))
        .when(
            first_err.isNotNull(),
            F.when(is_nxdomain(first_err), F.lit(NXDOMAIN))
            .when(F.lower(first_err).contains("timeout"), F.lit(TIMEOUT))
            .otherwise(F.lit(FAILURE)),
        )
        .otherwise(F.lit(NXDOMAIN))
    )


def is_success(
    ns_error: Column | str = "ns_error", a: Column | str = "a", aaaa: Column | str = "aaaa"
) -> Column:
    """Whether ``dns_status`` is success: the short form for filters, which don't share subexpressions."""
    some = F.coalesce(F.size(_c(a)) > 0, F.lit(False)) | F.coalesce(F.size(_c(aaaa)) > 0, F.lit(False))
    return _c(ns_error).isNull() & some


def dns_error_text(
    domain: Column | str = "domain",
    ns_error: Column | str = "ns_error",
    a_error: Column | str = "a_error",
    aaaa_error: Column | str = "aaaa_error",
    a: Column | str = "a",
    aaaa: Column | str = "aaaa",
) -> Column:
    """The error text an unsuccessful observation carries (null on success)."""
    n_ips = F.coalesce(F.size(_c(a)), F.lit(0)) + F.coalesce(F.size(_c(aaaa)), F.lit(0))
    return (
        F.when(_c(ns_error).isNotNull(), _c(ns_error))
        .when(n_ips > 0, F.lit(None).cast("string"))
        .when(F.coalesce(_c(a_error), _c(aaaa_error)).isNotNull(), F.coalesce(_c(a_error), _c(aaaa_error)))
        .otherwise(F.concat(F.lit("No A or AAAA records found for "), _c(domain)))
    )


def all_ips(dns: Column | str = "dns") -> Column:
    """A records followed by AAAA records, order kept."""
    d = _c(dns)
    return F.concat(
        F.coalesce(d.getField("a_records"), F.array().cast("array<string>")),
        F.coalesce(d.getField("aaaa_records"), F.array().cast("array<string>")),
    )


def dns_is_empty(dns: Column | str = "dns") -> Column:
    d = _c(dns)
    return (
        (F.coalesce(F.size(d.getField("a_records")), F.lit(0)) <= 0)
        & (F.coalesce(F.size(d.getField("aaaa_records")), F.lit(0)) <= 0)
        & (F.coalesce(F.size(d.getField("ns_records")), F.lit(0)) <= 0)
    )
