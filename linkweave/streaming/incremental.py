"""Arriving pairs scored once: each micro-batch scores only pairs that aren't in the table yet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

KEY = ["s1", "src", "tgt"]


def unscored(pairs: DataFrame, done: DataFrame, key: list[str] = KEY) -> DataFrame:
    return pairs.dropDuplicates(key).join(done.select(*key), key, "left_anti")


def score_stream(stream: DataFrame, path: str, checkpoint: str, score: Callable[[DataFrame], DataFrame], key: list[str] = KEY):
    """Start a query that appends the scores of new pairs of ``stream`` to Parquet below ``path``, by batch.

    A batch that runs again overwrites its own folder, so that each pair is there once.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        target = f"{path}/batch={number}"
        try:
            done = spark.read.parquet(path).filter(f"batch < {number}")
        except Exception as error:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER" not in str(error):
                raise
            done = df.limit(0)
        score(unscored(df, done, key)).write.mode("overwrite").parquet(target)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
