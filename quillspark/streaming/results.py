"""Running summaries of results that arrive as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quillspark.operators.analyze import summary
from quillspark.schemas import RESULTS


def result_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(RESULTS).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def running_summary(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Rewrites the summary table with each batch; its state is a row for each configuration."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    writer = summary(stream).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
