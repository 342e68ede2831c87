"""Registered queries: stream offsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators.offsets import earliest_offsets, group_key
from tessera.plans import bindings as b
from tessera.plans.oracle_views import with_views
from tessera.plans.registry import register
from tessera.session import read_table


@register("earliest_offsets", with_views(
    'SELECT topic, part, min("offset") AS earliest FROM message_log GROUP BY topic, part', "message_log"))
def q_earliest_offsets(spark, sf):
    return earliest_offsets(b.message_log(spark, sf))


@register("group_key", """
SELECT o_orderkey, concat('app', CAST(o_custkey % 3 AS VARCHAR), '-', 'db_', o_orderpriority, '.',
                          't', CAST(o_orderkey AS VARCHAR)) AS group_id
FROM orders""")
def q_group_key(spark, sf):
    o = read_table(spark, sf, "orders")
    return o.select("o_orderkey", group_key(
        F.concat(F.lit("app"), (F.col("o_custkey") % 3).cast("string")),
        F.concat(F.lit("db_"), F.col("o_orderpriority")),
        F.concat(F.lit("t"), F.col("o_orderkey").cast("string"))).alias("group_id"))
