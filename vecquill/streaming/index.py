"""Incremental add and search: vectors arrive as a stream, queries are answered as they come.

Adding appends micro-batches to a Parquet folder, exactly once by the checkpoint. A batch of queries is searched
exactly against what the folder holds when the batch starts; its answers go to a folder of that batch, which a repeated
batch overwrites, so a lost executor or a restart neither loses nor doubles answers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from vecquill.operators import search


def add_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of (id, v) to the folder; all that is there now, then stop."""
    return rows.select("id", "v").writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def search_stream(queries: DataFrame, path: str, answers: str, checkpoint: str, k: int = 10, name: str = "ip") -> StreamingQuery:
    """(query_id, rank, id, distance) of a stream of queries (id, v), under ``answers``/batch=N."""

    def answer(batch: DataFrame, number: int) -> None:
        base = batch.sparkSession.read.parquet(path)
        search.knn(batch, base, k, name).write.mode("overwrite").parquet(f"{answers}/batch={number}")

    return queries.select("id", "v").writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class SlidingIndex:
    """The last ``slices`` slices of a stream of vectors, each a folder of its own; a step adds one and drops the oldest.

    A step writes its slice before it drops another, and a slice is read only if it is complete, so a stop between the two
    leaves a window that the next step mends.
    """

    def __init__(self, spark: SparkSession, path: str, slices: int):
        if slices < 1:
            raise ValueError("a window holds a slice at least")
        self.spark, self.path, self.slices = spark, path, slices
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.files, self.place = place.getFileSystem(spark._jsc.hadoopConfiguration()), place

    def numbers(self) -> list[int]:
        """The complete slices, oldest first."""
        if not self.files.exists(self.place):
            return []
        names = [s.getPath().getName() for s in self.files.listStatus(self.place)]
        whole = [n for n in names if n.startswith("slice=") and self.files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n.removeprefix("slice=")) for n in whole)

    def step(self, rows: DataFrame) -> None:
        """Adds (id, v) as the newest slice."""
        known = self.numbers()
        rows.select("id", "v").write.mode("overwrite").parquet(f"{self.path}/slice={known[-1] + 1 if known else 0}")
        for n in self.numbers()[: -self.slices]:
            self.files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/slice={n}"), True)

    def rows(self) -> DataFrame:
        """(id, v) of the window."""
        known = self.numbers()[-self.slices :]
        schema = "id long, v array<double>"
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/slice={n}" for n in known)) if known else self.spark.createDataFrame([], schema)

    def search(self, queries: DataFrame, k: int = 10, name: str = "l2") -> DataFrame:
        return search.knn(queries, self.rows(), k, name)
