"""Problem 1 on the tables: every time field as one UTC instant."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators.timestamps import with_utc_ms
from paperloom.session import table

#: Table, key and time field.
FIELDS = (
    ("podcast_comments", "comment_id", "published_at"),
    ("feishu_comments", "comment_id", "create_time"),
    ("docs_qq_meta", "doc_no", "create_time"),
    ("cbex_lots", "lot_id", "end_time"),
)


def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each record delivered: its table, key, text and instant."""
    parts = [
        table(spark, sf_dir, name).select(
            F.lit(name).alias("src_table"), F.col(key).alias("rec_id"), F.col(field).alias("written"), "origin", "captured_at", "loaded_at"
        )
        for name, key, field in FIELDS
    ]
    zones = table(spark, sf_dir, "origin_zones").groupBy("origin").agg(F.max("zone_name").alias("zone_name"), F.max("date_order").alias("date_order"))
    rows = reduce(DataFrame.unionByName, parts).join(zones, "origin", "left")
    return with_utc_ms(rows, "written", "zone_name", "date_order", "captured_at")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``p1_found``: the records whose field names exactly one instant.

    A record delivered more than once counts as last loaded, and of equal times
    of loading the later instant. Both are one decimal, which keeps the
    aggregation in hash maps; it runs map-side first.
    """
    rows = normalised(spark, sf_dir)
    rank = F.unix_micros("loaded_at").cast("decimal(20,0)") * F.lit(10**14).cast("decimal(15,0)") + F.coalesce("utc_ms", F.lit(0)).cast("decimal(14,0)")
    last = rows.groupBy("src_table", "rec_id").agg(F.max_by("utc_ms", rank).alias("utc_ms"))
    return last.where(F.col("utc_ms").isNotNull())


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``p1_coverage``: per table and origin, how many records name an instant."""
    rows = normalised(spark, sf_dir)
    return rows.groupBy("src_table", "origin").agg(
        F.count("*").alias("n_rows"), F.count("utc_ms").alias("n_instants"), F.min("utc_ms").alias("first_ms"), F.max("utc_ms").alias("last_ms")
    )
