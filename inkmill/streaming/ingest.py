"""An extension: a stream of new files into a table of chunks, a micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkmill.plans import pipeline
from inkmill.sources.documents import assemble, read_units

BINARY = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, folder: str, per_batch: int = 100) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(BINARY).option("maxFilesPerTrigger", per_batch).load(folder)


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch's chunks under its own batch number, so a batch that runs again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        docs = assemble(read_units(batch.select("path", "content"))).where("error IS NULL").withColumn("doc_id", F.col("path"))
        chunks = pipeline.chunks(pipeline.stages(docs))
        chunks.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return file_stream(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
