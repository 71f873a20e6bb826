"""Caption documents as a stream: each micro-batch is rewritten on its own, without state or watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.rewrite import rewrite
from ..sources.translators import Translator, stand_in

SCHEMA = "track_id string, url string, body string"


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).parquet(path)


def rewrite_stream(documents: DataFrame, output: str, checkpoint: str, translate: Translator = stand_in) -> StreamingQuery:
    """Writes a folder for each micro-batch, so that a repeated one replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        rewrite(batch, translate).write.mode("overwrite").parquet(f"{output}/epoch={epoch}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
