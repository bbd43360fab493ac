"""Source of DNS answers: passive-DNS rows in the ``dns_obs`` layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DNS_OBS_SCHEMA = (
    "domain STRING, observed_at TIMESTAMP, ns_error STRING, a_error STRING, aaaa_error STRING, "
    "ns ARRAY<STRING>, a ARRAY<STRING>, aaaa ARRAY<STRING>, latency_s DOUBLE"
)


def read_dns_observations(
    spark: SparkSession, path: str | None = None, streaming: bool = False, fmt: str = "parquet", **options
) -> DataFrame:
    """One row per resolution of a name, as a batch or a stream.

    ``fmt`` is ``parquet`` or ``json`` with ``path``, or ``kafka`` with the usual
    options and JSON values.  The schema is fixed: other fields are left out,
    missing ones are null, and rows without a name or a time (among them
    values that aren't JSON) are dropped, as no join can use them.
    """
    reader = spark.readStream if streaming else spark.read
    if fmt == "kafka":
        value = reader.format("kafka").options(**options).load().select(F.col("value").cast("string").alias("v"))
        obs = value.select(F.from_json("v", DNS_OBS_SCHEMA).alias("o")).select("o.*")
    else:
        obs = reader.format(fmt).schema(DNS_OBS_SCHEMA).options(**options).load(path)
    return obs.where(F.col("domain").isNotNull() & F.col("observed_at").isNotNull())
