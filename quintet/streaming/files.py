"""A batch run through a file stream, for tests and for replaying requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from quintet.session import shared_folder


def through_stream(rows: DataFrame, work: Callable[[DataFrame], DataFrame], files_at_once: int = 4, each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """rows (value string) written as files, read as a stream, worked on, and what it wrote.

    each: further work on every micro-batch by itself, for what a stream can't do.
    """
    spark = rows.sparkSession
    folder = shared_folder(spark, "stream")
    rows.write.text(f"{folder}/in")
    stream = work(spark.readStream.schema("value string").option("maxFilesPerTrigger", files_at_once).text(f"{folder}/in")).writeStream
    if each:
        stream = stream.foreachBatch(lambda part, n: each(part).write.mode("overwrite").parquet(f"{folder}/out/batch={n}"))
    else:
        stream = stream.format("parquet").option("path", f"{folder}/out")
    stream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    back = spark.read.parquet(f"{folder}/out")
    return back.drop("batch") if each else back
