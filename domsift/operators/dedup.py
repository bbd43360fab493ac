"""Alert keys and time-to-live suppression of repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from domsift.functions.text import tags_key
from domsift.operators.scan import look
from domsift.operators.store import stored

# Parts of the repeat key.
FIRST_RESOLUTION_MARK = "FIRST_RESOLUTION"
FIRST_RESOLUTION_SEP = "::"
KEY_SEP = "|"


def dedup_key_text(
    base: Column | str = "base_domain",
    domain: Column | str = "domain",
    tags: Column | str = "source_tag",
    first_resolution: Column | str = "resolved_after_nxdomain",
    compat: bool = False,
) -> Column:
    """The text a repeat key is hashed from.

    Standard alerts: registrable domain (or the name) + sorted tags joined
    by ``,``; first-resolution alerts: full name + tags + a marker, so they
    never collide with standard ones.  ``compat=True`` reproduces the source
    system's key without a separator between domain and tags (where
    ``a.co`` + ``mX`` equals ``a.com`` + ``X``).
    """
    b = F.col(base) if isinstance(base, str) else base
    d = F.col(domain) if isinstance(domain, str) else domain
    fr = F.col(first_resolution) if isinstance(first_resolution, str) else first_resolution
    tk = tags_key(tags)
    std = F.concat(F.coalesce(b, d), F.lit("" if compat else KEY_SEP), tk)
    frk = F.concat(d, F.lit(FIRST_RESOLUTION_SEP), tk, F.lit(FIRST_RESOLUTION_SEP), F.lit(FIRST_RESOLUTION_MARK))
    return F.when(F.coalesce(fr, F.lit(False)), frk).otherwise(std)


def dedup_key(**kw) -> Column:
    """SHA-256 (hex) of ``dedup_key_text``; only equality matters."""
    return F.sha2(dedup_key_text(**kw), 256)


def epoch_micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since the epoch, independent of the session time zone."""
    dtype = df.schema[ts].dataType
    if isinstance(dtype, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{ts}`)")
    return F.unix_micros(F.col(ts))


#: Most different times of a key that are folded in one row.
FOLD_TIMES = 20_000


def suppress_repeats(
    df: DataFrame, key: str, ts: str, ttl_seconds: float, order: str | None = None, fold_times: int = FOLD_TIMES
) -> DataFrame:
    """Flag each row ``passed``: first per key, then repeats held back until
    ``ttl`` after the last *passed* row (a repeat does not renew the hold).

    The rule is greedy: which row passes depends on the one that passed before.
    A key of at most ``FOLD_TIMES`` different times is folded over its sorted
    times; the others go by ``passing_times``, which spreads a key over all tasks.

    Expiry at exactly ``ttl`` passes. Of rows of one key and time the first by
    ``order`` can pass. A row without a time passes and holds nothing back. Rows
    without a key are one key.
    """
    ttl_us = int(round(ttl_seconds * 1_000_000))
    if ttl_us <= 0:
        return df.withColumn("passed", F.lit(True))
    keyed = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    numbered = df.withColumn("_k", keyed).withColumn("_t", epoch_micros(df, ts)).withColumn("_row", F.monotonically_increasing_id())
    rows = stored(numbered, "repeats")
    points = rows.where("_t is not null").select("_k", "_t")
    many = points.groupBy("_k").agg(F.count_distinct("_t").alias("_n")).where(F.col("_n") > fold_times).select("_k")
    if many.isEmpty():
        times = folded_times(points, ttl_us)
    else:
        many = stored(many, "hot")
        hot = passing_times(points.join(many, "_k", "left_semi"), ttl_us)
        times = folded_times(points.join(many, "_k", "left_anti"), ttl_us).unionByName(hot)
    # one row of each time that passes; only these few meet the whole rows again
    times = stored(times, "times")
    rank = F.struct(*([F.col(order).alias("_o")] if order else []), "_row")
    at = rows.select("_k", "_t", rank.alias("_rank")).join(times, ["_k", "_t"])
    first = stored(at.groupBy("_k", "_t").agg(F.min("_rank")["_row"].alias("_row")).select("_row", F.lit(True).alias("_hit")), "passing")
    flagged = rows.join(first, "_row", "left")
    passed = F.col("_t").isNull() | F.coalesce(F.col("_hit"), F.lit(False))
    return flagged.select(*df.columns, passed.alias("passed"))


def folded_times(times: DataFrame, ttl_us: int) -> DataFrame:
    """The (``_k``, ``_t``) that the greedy rule lets pass, of keys with few different times."""
    nothing = F.struct(F.lit(None).cast("bigint").alias("last"), F.array().cast("array<bigint>").alias("passed"))

    def step(acc: Column, t: Column) -> Column:
        on = acc["last"].isNull() | (t - acc["last"] >= ttl_us)
        return F.when(on, F.struct(t.alias("last"), F.concat(acc["passed"], F.array(t)).alias("passed"))).otherwise(acc)

    per = times.groupBy("_k").agg(F.sort_array(F.collect_set("_t")).alias("_times"))
    return per.select("_k", F.explode(F.aggregate("_times", nothing, step, lambda acc: acc["passed"])).alias("_t"))


def passing_times(times: DataFrame, ttl_us: int) -> DataFrame:
    """The (``_k``, ``_t``) of a table of keys and times that the greedy rule lets pass.

    A time of a key passes surely if the time before it lies ``ttl`` back or more
    (a root). From any time that passes, the next to pass is the first one at or
    after ``ttl`` later; these links are looked up inside (key, time bucket), so
    a hot key is spread over all tasks. Times on the chains that begin at roots
    are marked by pointer doubling, in as many rounds as the longest chain has
    binary digits. Links into roots are left out, as are those that nothing on a
    chain can reach.
    """
    points = times.distinct()
    width = ttl_us / 1_000_000
    t = F.col("_t")
    before = look(points, ["_k"], t, t, "_before", bucket_seconds=width)
    points = stored(before.select("_k", "_t", (t - F.coalesce("_before", t - ttl_us) >= ttl_us).alias("root")), "points")
    # each time asks at t + ttl for the first time there or later
    asked = points.where("not root").select("_k", t.alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("bigint").alias("a"))
    asked = asked.unionByName(points.select("_k", (t + ttl_us).alias("_at"), F.lit(0).alias("_kind"), t.alias("a")))
    asked = asked.unionByName(points.where("root").select("_k", t.alias("_at"), F.lit(2).alias("_kind"), F.lit(None).cast("bigint").alias("a")))
    there = F.when(F.col("_kind") > 0, F.struct(F.col("_at").alias("t"), (F.col("_kind") == 2).alias("root")))
    told = look(asked, ["_k"], F.col("_at"), there, "_next", ["_kind"], ahead=True, bucket_seconds=width)
    links = stored(told.where("_kind = 0 and not _next.root").select("_k", "a", F.col("_next.t").alias("b")), "links")
    reached = points.where("root").select("_k", "_t")
    starts = reached.unionByName(links.select("_k", F.col("b").alias("_t"))).distinct()
    jumps = stored(links.join(starts.withColumnRenamed("_t", "a"), ["_k", "a"], "left_semi"), "jumps")
    while not jumps.isEmpty():
        more = reached.join(jumps, (reached["_k"] == jumps["_k"]) & (reached["_t"] == jumps["a"])).select(jumps["_k"], F.col("b").alias("_t"))
        reached = stored(reached.unionByName(more).distinct(), "reached")
        then = jumps.select(F.col("_k").alias("_k2"), F.col("a").alias("b2"), F.col("b").alias("c"))
        jumps = stored(jumps.join(then, (F.col("_k") == F.col("_k2")) & (F.col("b") == F.col("b2"))).select("_k", "a", F.col("c").alias("b")), "jumps")
    return reached
