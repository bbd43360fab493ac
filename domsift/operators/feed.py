"""Feed-side operators: sampling and exact-name lists."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample_feed(df: DataFrame, rate: float, seed: int | None = None) -> DataFrame:
    """Independent Bernoulli trial per name occurrence.

    ``rate >= 1`` passes everything; a rate outside [0, 1] is an error.  Uses
    a ``rand`` filter, which (unlike ``DataFrame.sample``) also works on
    streams.
    """
    if rate < 0 or rate > 1:
        raise ValueError(f"sample rate must be within [0, 1], got {rate}")
    if rate >= 1:
        return df
    return df.where(F.rand(seed) < F.lit(rate))


def sample_repeatable(df: DataFrame, id_col: str, rate: float, multiplier: int = 7919, modulus: int | None = None) -> DataFrame:
    """Deterministic sample: keep a row when ``(id * multiplier) mod modulus < rate * modulus``.

    The modulus is the power of ten, 1,000 at least, in whose steps the rate can
    be counted exactly (nine digits at most), so small rates are kept too; ids
    of any size are taken.

    The same row is kept on every run and on every recomputation of a lost
    task, which a ``rand`` draw does not promise.
    """
    if rate < 0 or rate > 1:
        raise ValueError(f"sample rate must be within [0, 1], got {rate}")
    if modulus is None:
        digits = -Decimal(str(rate)).normalize().as_tuple().exponent
        modulus = 10 ** min(9, max(3, digits))
    return df.where(F.pmod(F.pmod(F.col(id_col), F.lit(modulus)).cast("long") * F.lit(multiplier), F.lit(modulus)) < F.lit(rate * modulus))


def ignored_names(df: DataFrame, names: DataFrame, domain: str = "domain", allow: bool = False, broadcast_limit: int = 5_000_000) -> DataFrame:
    """Exact-name deny list (``left_anti``) or allow list (``left_semi``).

    The list is broadcast only after its row count is checked; a longer
    list is joined by shuffle.
    """
    lst = names.select(F.col(names.columns[0]).alias(domain)).distinct()
    if lst.count() <= broadcast_limit:
        lst = F.broadcast(lst)
    return df.join(lst, domain, "left_semi" if allow else "left_anti")
