"""ASN range table: headerless TSV ``start_ip end_ip asn country description``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domsift.functions.ip import ip_key, ip_version

ASN_TSV_SCHEMA = "start_ip STRING, end_ip STRING, asn BIGINT, country STRING, description STRING"


#: ``row_ord`` is the file's place times 2^50 plus the line's place in the file.
FILE_STRIDE = 1 << 50


def read_asn_ranges(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Load ranges as ``(ver, lo, hi, as_number, as_name, country_code, row_ord)``.

    Rows with ``asn == 0`` ("not routed") are skipped before their addresses
    are parsed; a short row, a bad address or a range that ends before it
    starts fails the whole load.  ``row_ord`` is the order of the files as
    given and of the lines in each (later rows overwrite earlier overlaps);
    each path must be one file, as a folder has no order.
    """
    paths = [path] if isinstance(path, str) else list(path)
    if len(paths) > 8000:
        raise ValueError("at most 8000 files have places of their own in row_ord")
    lines = None
    for i, one in enumerate(paths):
        ord_ = F.lit(i * FILE_STRIDE) + F.monotonically_increasing_id()
        part = spark.read.text(one).where(F.length("value") > 0).select("value", ord_.alias("row_ord"))
        lines = part if lines is None else lines.unionByName(part)
    f = F.split(F.col("value"), "\t")
    raw = lines.select(
        F.when(F.size(f) != 5, F.raise_error(F.concat(F.lit("ASN rows need 5 tab-separated fields: "), F.col("value"))))
        .otherwise(f.getItem(0))
        .alias("start_ip"),
        f.getItem(1).alias("end_ip"),
        f.getItem(2).cast("bigint").alias("asn"),
        f.getItem(3).alias("country"),
        f.getItem(4).alias("description"),
        "row_ord",
    )
    return asn_ranges_from_rows(raw)


def asn_ranges_from_rows(raw: DataFrame, order_col: str = "row_ord") -> DataFrame:
    """Validate and key a range table that already has the five TSV columns."""
    checked = raw.where(F.col("asn") != 0)
    keyed = checked.select(
        "*",
        ip_version("start_ip").alias("_vlo"),
        ip_version("end_ip").alias("_vhi"),
        ip_key("start_ip").alias("_lo"),
        ip_key("end_ip").alias("_hi"),
    )
    bad = (
        F.col("_lo").isNull() | F.col("_hi").isNull() | (F.col("_vlo") != F.col("_vhi")) | (F.col("_lo") > F.col("_hi"))
    )
    return keyed.select(
        F.when(bad, F.raise_error(F.concat(F.lit("bad range in ASN table: "), F.col("start_ip"), F.lit(" - "), F.col("end_ip"))))
        .otherwise(F.col("_vlo"))
        .alias("ver"),
        F.col("_lo").alias("lo"),
        F.col("_hi").alias("hi"),
        F.col("asn").alias("as_number"),
        F.col("description").alias("as_name"),
        F.col("country").alias("country_code"),
        F.col(order_col).alias("row_ord"),
    )
