"""Registrable domain (eTLD+1) from a public-suffix rule table.

Rules are plain suffixes (``com``, ``co.uk``), wildcards (``*.ck``) and
exceptions (``!www.ck``).  The longest matching rule wins, an exception
beats everything and gives up its leftmost label, and a name that matches
no rule falls back to its last label (the implicit ``*`` rule).  The
registrable domain is the public suffix plus one more label; a name that
*is* a public suffix (e.g. a single label) has none (null).

Names are compared without regard to case and without one trailing dot;
the registrable domain is given in lower case, so spellings of one name
share their repeat key and digest entry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def _rule_table(suffixes: DataFrame, rule: str) -> DataFrame:
    """Rules as ``(_key, _exact, _wild, _exc)``: the text behind ``*.`` or ``!`` and the kinds it has."""
    text = F.lower(F.trim(F.col(rule)))
    kinds = suffixes.select(
        F.regexp_replace(text, r"^(\*\.|!)", "").alias("_key"),
        text.startswith("*.").alias("_w"),
        text.startswith("!").alias("_x"),
    ).where(F.col("_key") != "")
    return kinds.groupBy("_key").agg(
        F.max(~F.col("_w") & ~F.col("_x")).alias("_exact"), F.max("_w").alias("_wild"), F.max("_x").alias("_exc")
    )


def registrable_domain(
    df: DataFrame,
    suffixes: DataFrame,
    domain: str = "domain",
    out: str = "base_domain",
    rule: str = "rule",
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Attach ``out`` (null when the name has no registrable part).

    The suffixes of 1, 2, .. labels of each name are looked up in turn, up to
    the longest rule, so rows stay where they are and the input is read once.
    The rule table is measured first: within ``max_broadcast_bytes`` it is
    broadcast, beyond that Spark chooses the join.
    """
    rules = _rule_table(suffixes, rule)
    depth, n_bytes = rules.agg(F.max(F.size(F.split("_key", r"\."))), F.sum(F.octet_length("_key") + 16)).first()
    side = F.broadcast(rules) if (n_bytes or 0) <= max_broadcast_bytes else rules
    keep = [c for c in df.columns if c != out]
    labels = F.split(F.lower(F.regexp_replace(F.col(domain), r"\.$", "")), r"\.")
    res = df.select(*keep, labels.alias("_rd_l"))
    n = F.size("_rd_l")
    exceptions, matches = [], []
    for k in range(1, (depth or 0) + 1):
        level = side.select(*[F.col(c).alias(f"_rd{c}{k}") for c in ("_key", "_exact", "_wild", "_exc")])
        last_k = F.when(n >= k, F.array_join(F.slice("_rd_l", -k, k), "."))
        res = res.join(level, last_k == F.col(f"_rd_key{k}"), "left")
        exceptions.append(F.when(F.col(f"_rd_exc{k}"), F.lit(k - 1)))
        matches.append(F.when(F.col(f"_rd_wild{k}") & (n > k), F.lit(k + 1)).when(F.col(f"_rd_exact{k}"), F.lit(k)))
    longest = lambda found: F.array_max(F.array(*found, F.lit(None).cast("int")))
    suffix_len = F.coalesce(longest(exceptions), longest(matches), F.lit(1))
    res = res.select(*keep, "_rd_l", suffix_len.alias("_rd_n"))
    base = F.when(n > F.col("_rd_n"), F.array_join(F.slice("_rd_l", -(F.col("_rd_n") + 1), F.col("_rd_n") + 1), "."))
    return res.select(*keep, base.alias(out))


def registrable_domains(names: DataFrame, suffixes: DataFrame, domain: str = "domain", rule: str = "rule") -> DataFrame:
    """Distinct names -> ``(domain, base_domain)``."""
    distinct = names.select(domain).where(F.col(domain).isNotNull()).distinct()
    return registrable_domain(distinct, suffixes, domain, "base_domain", rule)
