"""Stream offsets and consumer lag.

``log``      topic, part, offset          one row per message (or per offset range)
``offsets``  group_id, topic, part, end_offset, committed
Keyed aggregations only; the per-partition results are tiny.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def earliest_offsets(log: DataFrame) -> DataFrame:
    """Smallest offset of each (topic, partition): where a reset consumer group starts."""
    return log.groupBy("topic", "part").agg(F.min("offset").alias("earliest"))


def group_key(app: Column, database: Column, table: Column) -> Column:
    """Consumer group of a stream table: ``<app>-<database>.<table>``."""
    return F.concat(app, F.lit("-"), database, F.lit("."), table)


def consumer_lag(offsets: DataFrame) -> DataFrame:
    """``# data-received``: at least one partition and every partition's lag is 0."""
    lag = F.col("end_offset") - F.col("committed")
    return (offsets.groupBy("group_id", "topic")
            .agg(F.count(F.lit(1)).alias("n_parts"), F.sum(lag).alias("lag"),
                 F.bool_and(F.coalesce(lag == 0, F.lit(False))).alias("__all"))
            .select("group_id", "topic", "n_parts", "lag",
                    F.when((F.col("n_parts") > 0) & F.col("__all"), "Pass")
                     .otherwise("DataNotReceived").alias("verdict")))
