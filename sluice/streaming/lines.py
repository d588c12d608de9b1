"""Record-by-record filters over growing folders of text, and windowed counts over event streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: What a stream can be written as; the other formats need all results together.
OUTPUTS = ("jsonl", "csv", "tsv")


def stream_jsonl(spark: SparkSession, folder: str, schema: str, files_each: int = 100) -> DataFrame:
    """A stream of the objects, a line each, in a folder's files; blank lines are left out.

    `src_file` names the file; a line that is no JSON has null columns and its text in `bad_line`.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files_each).text(folder).where(F.trim("value") != "")
    parsed = F.from_json("value", f"{schema}, bad_line string", {"columnNameOfCorruptRecord": "bad_line"})
    return lines.select(F.col("_metadata.file_path").alias("src_file"), parsed.alias("r")).select("src_file", "r.*")


def write_stream(stream: DataFrame, render: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, all_now: bool = True) -> StreamingQuery:
    """Lines of a stream to text files, each record once; with all_now what is there now, then the query ends."""
    writer = render(stream).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if all_now else writer).start()


def windowed_counts(events: DataFrame, time: str, window: str, late: str, *keys: str) -> DataFrame:
    """start, keys, n: events in windows of time; windows are closed when the watermark has passed them."""
    own = F.window(time, window)
    counts = events.withWatermark(time, late).groupBy(own.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("start"), *keys, "n")


def all_counts(counts: DataFrame, folder: str) -> DataFrame:
    """The counts of an aggregated stream when all that is there now is taken in, of open windows too.

    Each round writes all counts to a folder of its own; the last round's are read.
    """
    spark, rounds = counts.sparkSession, []

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/out/{number}")
        rounds.append(number)

    run = counts.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/state").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    if not rounds:
        return spark.createDataFrame([], counts.schema)
    return spark.read.schema(counts.schema).parquet(f"{folder}/out/{max(rounds)}")
