"""Incremental processing: only files that appeared since the last run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def process_new_tiles(spark: SparkSession, source: str, schema: str, target: str, progress: str,
                      transform: Callable[[DataFrame], DataFrame], file_format: str = "parquet",
                      files_per_batch: int = 1000, pattern: str = "*") -> None:
    """Run ``transform`` on the files (of a name pattern) that arrived under ``source`` and end.

    The progress folder remembers what was seen.  Each batch writes its own folder and overwrites it
    when it is repeated after a failure, so results never double.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    query = (
        spark.readStream.schema(schema).format(file_format).option("maxFilesPerTrigger", files_per_batch)
        .option("pathGlobFilter", pattern).load(source)
        .writeStream.foreachBatch(handle).option("checkpointLocation", progress).trigger(availableNow=True).start()
    )
    query.awaitTermination()
