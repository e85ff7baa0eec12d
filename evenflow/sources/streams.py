"""Streaming sources and sinks: one JSON object per row.

The Kafka connector is part of the Spark distribution's optional packages; options are passed through. The
file source has the same shape and needs no broker.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

#: Key of a stream that is not split by any column.
DEFAULT_KEY = "stream"


def read_kafka(spark: SparkSession, servers: str, topic: str, schema: StructType,
               options: Mapping[str, str] | None = None, streaming: bool = True) -> DataFrame:
    """Rows of a topic from the earliest offset, with ``stream_key`` and their order (``partition``, ``offset``)."""
    reader = spark.readStream if streaming else spark.read
    raw = (
        reader.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
        .option("startingOffsets", "earliest").options(**(options or {})).load()
    )
    return decode_messages(raw, schema)


def decode_messages(raw: DataFrame, schema: StructType) -> DataFrame:
    """Parse (key, value, partition, offset, timestamp) messages into typed rows."""
    return raw.select(
        F.col("key").cast("string").alias("stream_key"), "partition", "offset",
        F.col("timestamp").alias("arrival"), F.from_json(F.col("value").cast("string"), schema).alias("_row"),
    ).select("stream_key", "partition", "offset", "arrival", "_row.*")


def read_files(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1,
               file_format: str = "parquet") -> DataFrame:
    """Streaming file source."""
    return (
        spark.readStream.schema(schema).format(file_format)
        .option("maxFilesPerTrigger", files_per_trigger).load(path)
    )


def encode_messages(df: DataFrame, key: Column | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """(key, value) messages: one JSON object per row under the stream's key."""
    body = F.struct(*[F.col(c) for c in (columns or df.columns)])
    return df.select((F.lit(DEFAULT_KEY) if key is None else key.cast("string")).alias("key"),
                     F.to_json(body, {"ignoreNullFields": "false"}).alias("value"))


def write_kafka(messages: DataFrame, servers: str, topic: str, checkpoint: str | None = None):
    """Publish (key, value) messages; a streaming frame needs a checkpoint folder and returns its query."""
    options = {"kafka.bootstrap.servers": servers, "topic": topic}
    if messages.isStreaming:
        return (
            messages.writeStream.format("kafka").options(**options).option("checkpointLocation", checkpoint)
            .outputMode("append").start()
        )
    return messages.write.format("kafka").options(**options).save()


def append_sink(df: DataFrame, path: str, checkpoint: str, file_format: str = "parquet") -> DataStreamWriter:
    """Append-only file sink for delivered rows or window records; start it, or add a trigger first."""
    return (
        df.writeStream.format(file_format).option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append")
    )


def commit_sink(df: DataFrame, path: str, checkpoint: str, name: str, file_format: str = "parquet",
                after: Callable[[int], None] | None = None) -> DataStreamWriter:
    """Sink that holds every micro-batch once, also when Spark repeats it; start it, or add a trigger first.

    Between the write of a batch and its entry in the checkpoint a driver may be lost, and the restarted query gets
    that batch again. Each batch has its folder, named by query and batch; a finished one has its success marker and is
    not written a second time, a half-written one is replaced. ``after`` runs once a batch is there, before Spark notes
    it. ``name`` must stay the same over restarts and be different for every query that writes to ``path``.
    """
    def write(batch: DataFrame, number: int) -> None:
        folder = f"{path}/query={name}/batch={number}"
        if not _matches(batch.sparkSession, f"{folder}/_SUCCESS"):
            batch.write.format(file_format).mode("overwrite").option(
                "mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").save(folder)
        if after is not None:
            after(number)

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def read_committed(spark: SparkSession, path: str, schema: StructType, file_format: str = "parquet") -> DataFrame:
    """Rows of all finished batches of a ``commit_sink`` with their ``query`` and ``batch``.

    The driver lists one marker per batch. Batches that are still being written, or never were finished, are left out.
    """
    done = [marker.rsplit("/", 1)[0] for marker in _matches(spark, f"{path}/query=*/batch=*/_SUCCESS")]
    full = StructType([*schema.fields, *StructType.fromDDL("query string, batch long").fields])
    if not done:
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("basePath", path).format(file_format).load(done)


def _matches(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that fit a pattern, on whichever file system it names."""
    glob = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = glob.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(glob)
    return [status.getPath().toString() for status in found or ()]
