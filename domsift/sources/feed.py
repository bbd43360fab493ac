"""Feed source: collector-landed messages -> one row per domain name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_feed(spark: SparkSession, path: str, streaming: bool = False, fmt: str = "text", **options) -> DataFrame:
    """Raw feed messages as ``value STRING`` (text/JSON lines, or Kafka's value).

    ``fmt='kafka'`` expects the usual Kafka options (subscribe, bootstrap
    servers) and casts the record value to text; ``fmt='parquet'`` reads a
    landed table with a ``value`` column.
    """
    reader = spark.readStream if streaming else spark.read
    if fmt == "kafka":
        df = reader.format("kafka").options(**options).load()
        return df.select(F.col("value").cast("string").alias("value"), F.col("timestamp").alias("seen_at"))
    if fmt == "parquet":
        if streaming:
            schema = options.pop("schema")
            return reader.schema(schema).options(**options).parquet(path)
        return reader.options(**options).parquet(path)
    return reader.options(**options).text(path)


def _message_names(value: Column, strict: bool, fmt: str) -> Column:
    path = "$.data" if fmt == "names" else "$.data.leaf_cert.all_domains"
    if strict:
        arr = F.try_variant_get(F.try_parse_json(value), path, "array<variant>")
        ok = F.forall(arr, lambda x: F.schema_of_variant(x) == F.lit("STRING"))
        names = F.transform(arr, lambda x: F.variant_get(x, "$", "string"))
        return F.when(ok, names)
    schema = "data ARRAY<STRING>" if fmt == "names" else "data STRUCT<leaf_cert: STRUCT<all_domains: ARRAY<STRING>>>"
    parsed = F.from_json(value, schema)
    return parsed.getField("data") if fmt == "names" else parsed.getField("data").getField("leaf_cert").getField(
        "all_domains"
    )


def parse_messages(
    df: DataFrame,
    col: str = "value",
    strict: bool = True,
    fmt: str = "names",
    keep: list[str] | None = None,
    with_position: bool = False,
) -> DataFrame:
    """``{"data": [names]}`` text -> one row per name (``domain``).

    Malformed JSON, a missing or non-list ``data`` drop the message; an empty
    list yields nothing; duplicates are kept; names are not normalised.
    ``strict`` also drops a message whose list holds a non-string element
    (instead of Spark's coercion of numbers to text).  ``fmt='full'`` reads
    ``data.leaf_cert.all_domains`` of full certificate records.
    """
    keep = [c for c in (keep or df.columns) if c != col]
    names = _message_names(F.col(col), strict, fmt)
    if with_position:
        return df.select(*keep, F.posexplode(names).alias("name_pos", "domain"))
    return df.select(*keep, F.explode(names).alias("domain"))
