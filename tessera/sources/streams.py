"""Stream sinks and replays.

``to_stream`` sends lines to a topic with the partition chosen round-robin
by row number (null key, all-replica acks when Kafka is the sink), to a Kafka
server if one is given, else to a file sink partitioned by (topic, partition);
``stream_to_topic`` does so from a stream, batch by batch, each exactly once.
``replay_files`` turns a folder of text files into a stream whose topic is the
file's name, drained with ``availableNow`` into a sink folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.session import scratch_path


def kafka_available(spark: SparkSession) -> bool:
    try:
        spark._jvm.java.lang.Class.forName("org.apache.spark.sql.kafka010.KafkaSourceProvider")
        return True
    except Exception:  # noqa: BLE001
        return False


def to_stream(df: DataFrame, topic: str | Column, path: str | None = None, parts: int = 4,
              row_col: str = "id", bootstrap: str | None = None) -> str | None:
    """Write ``value`` lines to ``topic`` (a name, or a column of names); partition = row number mod ``parts``."""
    out = _topic_rows(df, topic, parts, row_col)
    spark = df.sparkSession
    if bootstrap:
        if not kafka_available(spark):
            raise RuntimeError("a Kafka server is given, but Spark's Kafka connector is not on the classpath")
        (out.write.format("kafka").option("kafka.bootstrap.servers", bootstrap)
         .option("kafka.acks", "all").save())
        return None
    path = path or scratch_path(spark, "topics")
    out.drop("key").write.mode("append").partitionBy("topic", "partition").parquet(path)
    return path


def _topic_rows(df: DataFrame, topic: str | Column, parts: int, row_col: str) -> DataFrame:
    return df.select((F.lit(topic) if isinstance(topic, str) else topic).alias("topic"),
                     F.pmod(F.col(row_col), F.lit(parts)).cast("int").alias("partition"),
                     F.lit(None).cast("string").alias("key"), F.col("value"))


def stream_to_topic(stream: DataFrame, topic: str | Column, path: str, checkpoint: str, parts: int = 4,
                    row_col: str = "id") -> StreamingQuery:
    """Start the writing of a stream's ``value`` lines to ``topic`` below ``path``; the query ends with what there is.

    A batch counts once its files are in the sink's log, under its number: started again with the same checkpoint, a
    query that broke off goes on behind the last such batch, and what it has left of another one is not read.
    """
    return (_topic_rows(stream, topic, parts, row_col).drop("key").writeStream.format("parquet")
            .partitionBy("topic", "partition").option("path", path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


TOPIC_SCHEMA = "value string, topic string, partition int"


def read_topic(spark: SparkSession, path: str, topic: str) -> DataFrame:
    """The lines of a topic that ``to_stream`` has written below ``path``, as a stream of (value)."""
    return (spark.readStream.schema(TOPIC_SCHEMA).parquet(path).where(F.col("topic") == topic).select("value"))


def replay_files(spark: SparkSession, folder: str, sink: str | None = None,
                 checkpoint: str | None = None) -> DataFrame:
    """Stream every text file below ``folder`` and drain it: (topic, path, value), the topic being the file's name."""
    sink = sink or scratch_path(spark, "replay")
    checkpoint = checkpoint or scratch_path(spark, "replay-ckpt")
    s = (spark.readStream.format("text").option("recursiveFileLookup", "true").load(folder)
         .select(F.col("_metadata.file_name").alias("topic"), F.col("_metadata.file_path").alias("path"), "value"))
    q = (s.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(sink)
