"""Looking back and ahead along a key's rows without one task for the whole key.

A window over all rows of a key puts a hot key into one task. Here a key's rows
are cut into time buckets. Each bucket is summed up (a partial aggregate), the
summaries alone are scanned along the key, and what a bucket inherits is joined
back to its rows, which then only look around inside their own bucket. Tasks
hold one (key, bucket) each; the scan holds one small row a bucket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Default width of a bucket.
BUCKET_SECONDS = 3600.0


def bucket_of(us: Column, width_us: int) -> Column:
    """Number of the time bucket; null times share the null bucket."""
    return F.floor(us / F.lit(width_us)).cast("bigint")


def join_null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Equi-join in which nulls meet nulls; the right side's keys go."""
    renamed = reduce(lambda d, c: d.withColumnRenamed(c, f"_r_{c}"), on, right)
    same = reduce(lambda a, b: a & b, [left[c].eqNullSafe(renamed[f"_r_{c}"]) for c in on])
    return left.join(renamed, same, how).drop(*[f"_r_{c}" for c in on])


def look(
    df: DataFrame, keys: list[str], us: Column, value: Column, name: str, tie: list[str] | None = None,
    ahead: bool = False, bucket_seconds: float = BUCKET_SECONDS,
) -> DataFrame:
    """Add ``name``: the last ``value`` that is not null on an earlier row of the key, or the next one with ``ahead``.

    Rows are in the order of (``us``, ``tie``); null times come first, null keys
    are one key. The row itself doesn't count.
    """
    tie = tie or []
    rank = F.struct("_us", *[F.col(c) for c in tie])
    rows = df.withColumn("_us", us).withColumn("_value", value)
    rows = rows.withColumn("_bucket", bucket_of(F.col("_us"), max(1, int(round(bucket_seconds * 1_000_000)))))
    end = F.min_by if ahead else F.max_by
    summed = rows.groupBy(*keys, "_bucket").agg(end("_value", F.when(F.col("_value").isNotNull(), rank)).alias("_end"))
    order = [F.desc("_bucket")] if ahead else [F.asc("_bucket")]
    along = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    carried = summed.select(*keys, "_bucket", F.last("_end", ignorenulls=True).over(along).alias("_carried"))
    met = join_null_safe(rows, carried, [*keys, "_bucket"])
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*[F.desc(c) if ahead else F.asc(c) for c in ("_us", *tie)])
    found = F.last("_value", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    return met.withColumn(name, F.coalesce(found, F.col("_carried"))).drop("_us", "_value", "_bucket", "_carried")


def trailing(df: DataFrame, keys: list[str], us: Column, window_seconds: float, sums: dict[str, Column]) -> DataFrame:
    """Add sums over the key's rows of the trailing ``window_seconds`` (both ends included, rows of equal time too).

    ``sums`` are of whole numbers or decimals. Buckets are as wide as the window, so
    a row's window lies in its own bucket and the one before: every row is also
    dealt, as context only, to the next. There it counts from the start and leaves
    when the window has passed it, so that one running sum gives every row's answer
    and a bucket of n rows costs n steps after its sort. Rows without a time are
    each other's window.
    """
    width = max(1, int(round(window_seconds * 1_000_000)))
    rows = df.withColumn("_us", us)
    own = bucket_of(F.col("_us"), width)
    dealt = rows.select("*", F.posexplode(F.when(own.isNull(), F.array(own)).otherwise(F.array(own, own + 1))).alias("_context", "_bucket"))
    left = F.col("_context") == 1
    dealt = dealt.withColumn("_at", F.when(left, F.col("_us") + width + 1).otherwise(F.col("_us")))
    whole = Window.partitionBy(*keys, "_bucket").orderBy("_at")
    before = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    running = whole.rangeBetween(Window.unboundedPreceding, Window.currentRow)

    def within(value: Column) -> Column:
        came = F.sum(F.when(left, -value).otherwise(value)).over(running)
        return F.coalesce(F.sum(F.when(left, value)).over(before), F.lit(0)) + came

    counted = {n: within(F.when(c.isNotNull(), 1).otherwise(0).cast("bigint")) for n, c in sums.items()}
    summed = dealt.select("*", *[F.when(counted[n] > 0, within(F.coalesce(c, F.lit(0)))).alias(n) for n, c in sums.items()])
    return summed.where("_context = 0").drop("_us", "_bucket", "_context", "_at")


def carry_along(df: DataFrame, part: str, order: list[str], value: str, name: str) -> DataFrame:
    """Add ``name``: the last ``value`` that is not null up to the row, over parts that follow one another in order.

    ``part`` numbers range partitions in the order of ``order``. Parts are swept
    apart; each one's last value is handed on by a table of one row a part.
    """
    rank = F.struct(*[F.col(c) for c in order])
    ends = df.groupBy(part).agg(F.max_by(value, F.when(F.col(value).isNotNull(), rank)).alias("_end"))
    # one row a partition
    along = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(part, F.last("_end", ignorenulls=True).over(along).alias("_carried"))
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    met = df.join(F.broadcast(carried), part, "left")
    return met.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col("_carried"))).drop("_carried")
