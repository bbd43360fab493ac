"""Mergeable quantiles: counts by logarithmic bucket, stored once and added up over any windows.

A value ``x > 0`` is counted in bucket ``ceil(log_g(x))`` with
``g = (1 + error) / (1 - error)``; the bucket's middle is within the relative
``error`` of all its values. A sketch is a table of (keys, bucket, n), so merging
is a sum, partial sums combine before the shuffle, and the same aggregation runs
on streams. A key has about ``log_g(largest / smallest)`` buckets, whatever its rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ERROR = 0.01
#: Values up to this size count as zero.
ZERO = 1e-9
_ZERO_BUCKET = -(1 << 31)


def _gamma(error: float) -> float:
    if not 0 < error < 1:
        raise ValueError("error must lie between 0 and 1")
    return (1 + error) / (1 - error)


def quantile_sketch(df: DataFrame, by: list[str | Column], value: str, error: float = ERROR) -> DataFrame:
    """(``by``, ``bucket``, ``n``) of a column of times or sizes, batch or stream (``by`` may hold a time window).

    Null, NaN and infinite values are left out; values below zero count as zero.
    """
    x = F.col(value).cast("double")
    finite = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf)))
    bucket = F.when(x <= ZERO, F.lit(_ZERO_BUCKET)).otherwise(F.ceil(F.log(x) / F.lit(math.log(_gamma(error)))).cast("int"))
    return finite.groupBy(*by, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge_sketches(sketch: DataFrame, by: list[str | Column]) -> DataFrame:
    """Sketches of the same error summed up over fewer keys or wider windows."""
    return sketch.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))


def sketch_quantiles(sketch: DataFrame, by: list[str], qs: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99), error: float = ERROR) -> DataFrame:
    """Count and nearest-rank quantiles (``p50``, ``p90``, ..) of each key, each within the relative ``error``."""
    g = _gamma(error)
    middle = F.when(F.col("bucket") == _ZERO_BUCKET, F.lit(0.0)).otherwise(F.pow(F.lit(g), F.col("bucket")) * F.lit(2 / (1 + g)))
    # a key's buckets are bounded by the error, not by its rows
    up_to = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sketch.withColumn("_upto", F.sum("n").over(up_to)).withColumn("_all", F.sum("n").over(Window.partitionBy(*by)))
    met = [F.min(F.when(F.col("_upto") >= F.greatest(F.ceil(F.col("_all") * F.lit(q)), F.lit(1)), F.struct("bucket", middle.alias("v")))) for q in qs]
    return ranked.groupBy(*by).agg(F.sum("n").alias("n"), *[m["v"].alias(f"p{q * 100:g}".replace(".", "_")) for m, q in zip(met, qs)])
