"""Listing files as a stream. Beyond the reference, whose increments are skip-if-known rules."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fiscalith.operators.rejects import R1_RECORD, split_records


def record_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New Parquet files of raw records, each read once."""
    return spark.readStream.schema(schema).parquet(folder)


def ingest_records(
    source: DataFrame, id_column: str, text_column: str, rows_path: str, rejects_path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Splits each micro-batch into typed rows and rejects, partitioned by batch, so that a batch that is run again after a failure
    replaces what it wrote before."""

    def write(batch: DataFrame, number: int) -> None:
        judged = split_records(batch, id_column, text_column, R1_RECORD).persist()
        try:
            for part, path in (
                (judged.where("reason IS NULL").select(id_column, "record.*"), rows_path),
                (judged.where("reason IS NOT NULL").select(id_column, "reason"), rejects_path),
            ):
                numbered = part.withColumn("batch", F.lit(number))
                numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
        finally:
            judged.unpersist()

    writer = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window and kind; rows later than ``late`` are left out of a stream's windows."""
    return (
        events.withWatermark(time, late)
        .groupBy(F.window(time, width).alias("w"), kind)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "n")
    )


def run_to_memory(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is available and gives its result; for tests and small results."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


