"""Registered queries: script files run as cases."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.plans.registry import register
from tessera.plans.script_runner import run_scripts
from tessera.session import read_table, scratch_path
from tessera.sources.streams import to_stream

#: One script a region. Cases define the same view and the same setting; a stream fills a table of the case.
SCRIPT = """-- time:120
create temporary view v as
  select c_custkey, c_acctbal from customer join nation on c_nationkey = n_nationkey where n_regionkey = ${region};
set case.region=${region};
select count(*) from v where c_acctbal < 0; -- target
set case.region; -- target
create table ${prefix}got(a bigint, b decimal(12,2));
create stream s(a bigint, b decimal(12,2)) row format delimited fields terminated by '|'
  tblproperties("topic"="customers_${region}");
insert into ${prefix}got select a, b from s where b < 0; -- stream
select count(*), sum(b) from ${prefix}got; -- target
select nope from v; -- error"""

GOLDEN = """### target start
${poor}
### target end
### target start
case.region ${region}
### target end
### target start
${sums}
### target end
### target start
UNRESOLVED_COLUMN.WITH_SUGGESTION
### target end"""


def _lines(regions, text: str):
    return regions.select("file", F.posexplode(F.lit(text.split("\n")))).toDF("file", "n", "line") \
        .withColumn("n", F.col("n").cast("long"))


@register("script_case", """
WITH n AS (SELECT r_regionkey AS k, CAST(r_regionkey AS VARCHAR) AS "case",
                  (SELECT count(*) FROM customer c JOIN nation ON c_nationkey = n_nationkey
                   WHERE n_regionkey = r.r_regionkey AND c_acctbal < 0) AS poor
           FROM region r)
SELECT "case", 0 AS target_idx, CASE WHEN k % 5 <> 0 OR poor = 0 THEN 'Pass' ELSE 'LinesNotMatch' END AS verdict FROM n
UNION ALL SELECT "case", 1, 'Pass' FROM n
UNION ALL SELECT "case", 2, CASE WHEN k % 7 = 3 THEN 'LinesNotMatch' ELSE 'Pass' END FROM n
UNION ALL SELECT "case", 3, 'Pass' FROM n""")
def q_script_case(spark, sf):
    """Scripts of all regions to verdicts; every fifth expects no customer in debt, every seventh a wrong sum."""
    customer, nation = read_table(spark, sf, "customer"), read_table(spark, sf, "nation")
    customer.createOrReplaceTempView("customer")
    nation.createOrReplaceTempView("nation")
    debt = (customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select("c_custkey", "n_regionkey", F.col("c_acctbal").cast("decimal(12,2)").alias("b")))
    topics = to_stream(debt.select(F.col("c_custkey").alias("id"), "n_regionkey",
                                   F.concat_ws("|", "c_custkey", "b").alias("value")),
                       F.concat(F.lit("customers_"), "n_regionkey"), row_col="id")
    regions = read_table(spark, sf, "region").select(F.col("r_regionkey").alias("file"))
    key = F.col("file").cast("string")
    sums = (debt.where("b < 0").groupBy(F.col("n_regionkey").alias("file"))
            .agg(F.concat_ws(" ", F.count(F.lit(1)).cast("string"), F.sum("b").cast("string")).alias("sums")))
    right = regions.join(sums, "file", "left").select(
        "file", F.when(F.col("file") % 7 == 3, "x x").otherwise(F.coalesce("sums", F.lit("0"))).alias("sums"))
    table = F.create_map(F.lit("region"), key, F.lit("poor"), F.when(F.col("file") % 5 == 0, "0").otherwise("[0-9]+"))
    golden = _lines(regions, GOLDEN).join(right, "file").withColumn("line", F.replace("line", F.lit("${sums}"), F.col("sums")))
    database = f"tessera_cases_{uuid.uuid4().hex}"
    spark.sql(f"create database {database} location '{scratch_path(spark, 'database')}'")
    try:
        out = run_scripts(spark, _lines(regions, SCRIPT), golden.select("file", "n", "line"), variables=table,
                          topics=topics, database=database, threads=8)
    finally:
        spark.sql(f"drop database {database} cascade")
    return out.drop("message")
