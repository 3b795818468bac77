"""Detection and masking of a stream: both are local to a row, so the batch plan serves as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maskwright.plans.engine import Engine


def read_blocks(spark: SparkSession, path: str, schema: str = "block_id string, text string", files_per_batch: int = 64) -> DataFrame:
    """Blocks from Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def masked(blocks: DataFrame, engine: Engine, mode: str = "character") -> DataFrame:
    """Blocks with ``findings`` and ``masked``; no state is kept."""
    return engine.mask(engine.analyze(blocks), mode=mode)


def write(df: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Append to Parquet files, each micro-batch once."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
