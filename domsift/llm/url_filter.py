"""URL allow/block rules by hashed host-suffix and path-prefix expressions.

Each URL is expanded into every (host suffix, path prefix) expression a rule
could be written as. Expressions and rules are digested with SHA-256; the join
runs on the first four bytes of the digest, the full digests are then compared,
and the longest confirmed rule decides.

Defined results
    * null URL, or no ``://``: host and path are empty, no rule fits;
    * a host is everything up to ``/ ? #`` or the end (ports and user names
      stay in it), A-Z lower-cased; the path ends before ``?`` or ``#``;
    * a path that is empty does not start with ``/``, so ``org/`` does not fit it;
    * two rules of the same length: the longer host wins, then ``block``;
    * repeated rows are judged once and come back as often as they came in;
    * an empty table gives no rows; columns other than ``id_col`` and
      ``url_col`` are never read, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX_HEX = 8  # four bytes of the digest
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host, path, verdict)
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def url_host(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(raw, _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def host_suffixes(host: Column) -> Column:
    """``a.b.org`` -> [``a.b.org``, ``b.org``, ``org``]; none for an empty host."""
    labels = F.split(host, r"\.")
    every = F.transform(
        labels,
        lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels) - i), "."),
    )
    return F.when(host != "", every).otherwise(F.array().cast("array<string>"))


def path_prefixes(path: Column, lengths: list[int]) -> Column:
    """The prefixes of the lengths at which any rule's path ends."""
    size = F.length(path)
    taken = [F.when(size >= n, F.substring(path, 1, n)) for n in lengths]
    return F.array_compact(F.array(*taken)) if taken else F.array().cast("array<string>")


def expressions(host: Column, path: Column, lengths: list[int]) -> Column:
    prefixes = path_prefixes(path, lengths)
    return F.flatten(F.transform(host_suffixes(host), lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))


def rule_table(spark: SparkSession, rules) -> DataFrame:
    """One row per digest prefix with the rules behind it (almost always one).

    ``rules``: list of (host, path, verdict) or a DataFrame of these columns.
    """
    if isinstance(rules, DataFrame):
        frame = rules.select("host", "path", "verdict")
    else:
        frame = spark.createDataFrame(list(rules), "host string, path string, verdict string")
    text = F.concat(F.translate("host", _UPPER, _LOWER), F.col("path"))
    digest = F.sha2(text, 256)
    rule = F.struct(
        F.length(text).alias("size"),
        F.length("host").alias("host"),
        (F.col("verdict") == "block").alias("blocks"),
        text.alias("rule"),
        digest.alias("digest"),
    )
    return (
        frame.where("host is not null and path is not null and verdict in ('allow', 'block')")
        .select(F.substring(digest, 1, PREFIX_HEX).alias("_rule_key"), rule.alias("_rule"))
        .groupBy("_rule_key")
        .agg(F.collect_set("_rule").alias("_rules"))
    )


def filter_urls(
    df: DataFrame, rules=None, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """``id_col, host, path, rule, verdict`` for every row of ``df``.

    ``rules`` given as a DataFrame: the distinct lengths of their paths (no more
    than the longest path has characters) are read first. Whether the rule side
    is broadcast is left to Spark, which does it below the session's byte
    threshold and otherwise shuffles both sides on the digest prefix.
    """
    spark = df.sparkSession
    rules = RULES if rules is None else rules
    frame = rule_table(spark, rules)
    if isinstance(rules, DataFrame):
        lengths = sorted(r[0] for r in rules.where("path is not null").select(F.length("path")).distinct().collect())
    else:
        lengths = sorted({len(p) for _, p, _ in rules})

    urls = df.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    parts = urls.withColumn("_host", url_host(F.col("_url"))).withColumn("_path", url_path(F.col("_url")))
    opened = parts.select(
        "_id", "_url", "_host", "_path", F.posexplode_outer(expressions(F.col("_host"), F.col("_path"), lengths)).alias("_n", "_expr")
    ).withColumn("_digest", F.sha2(F.col("_expr"), 256))
    keyed = opened.withColumn("_key", F.substring("_digest", 1, PREFIX_HEX))
    joined = keyed.join(frame, F.col("_key") == F.col("_rule_key"), "left")
    confirmed = F.filter("_rules", lambda r: r["digest"] == F.col("_digest"))
    judged = joined.groupBy("_id", "_url", "_host", "_path").agg(
        F.max(F.array_max(confirmed)).alias("_best"),
        # every row of the input has exactly one first expression, so this is how often it came in
        F.sum((F.coalesce(F.col("_n"), F.lit(0)) == 0).cast("long")).alias("_copies"),
    )
    verdict = F.when(F.col("_best").isNull(), F.lit(default)).otherwise(
        F.when(F.col("_best.blocks"), F.lit("block")).otherwise(F.lit("allow"))
    )
    return judged.select(
        F.col("_id").alias(id_col),
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_best.rule").alias("rule"),
        verdict.alias("verdict"),
        F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy"),
    ).drop("_copy")
