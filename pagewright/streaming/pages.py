"""The page queries over a stream of captured responses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

PAGES = "page_id BIGINT, url STRING, html STRING"


def page_stream(spark: SparkSession, folder: str, schema: str = PAGES, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run_to_end(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, unique: tuple[str, ...] = ("url",)) -> int:
    """Process all that is there, each key once over all runs (no key: each row once, and no state), and append the results;
    returns the number of batches.

    A batch writes to a folder of its own number and overwrites it when it is repeated, so a crash between the write and the
    checkpoint leaves no duplicates. The keys' state has no watermark: captured pages have no event time."""
    done = []

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")
        done.append(number)

    rows = stream.dropDuplicates(list(unique)) if unique else stream
    query = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(done)
