"""The functions on streams. All of them work a row at a time, so none keeps state; a corpus searched by a stream is static."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.knn import knn_join


def read_stream(spark: SparkSession, folder: str, schema, file_format: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(file_format).load(folder)


def with_columns(stream: DataFrame, **columns: Column) -> DataFrame:
    return stream.withColumns(columns)


def knn_stream(stream: DataFrame, corpus: DataFrame, k: int, sink: Callable[[DataFrame, int], None], checkpoint: str, **names: str) -> StreamingQuery:
    """Searches every micro-batch in ``corpus`` and hands the neighbours to ``sink``, which should write by batch number."""

    def each(batch: DataFrame, number: int) -> None:
        sink(knn_join(batch, corpus, k, **names), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
