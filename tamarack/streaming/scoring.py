"""A stream of queries scored against a corpus at rest, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tamarack.operators.bm25 import rank
from tamarack.operators.tables import kept


def score_stream(queries: DataFrame, docs: DataFrame, path: str, checkpoint: str, *, k: int = 10) -> StreamingQuery:
    """Rank the documents for each query (query_id, text) that arrives; rankings are Parquet, a folder per batch.

    A batch that runs again after a failure overwrites its own folder, and a query that an earlier batch ranked is left out, so a stream that is started anew with a new
    checkpoint ranks none twice. Of a batch's rows with one query_id the least text stays.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, folder = batch.sparkSession, f"{path}/batch={number}"
        one = batch.groupBy("query_id").agg(F.min("text").alias("text"))
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            schema = "query_id " + dict(batch.dtypes)["query_id"]
            done = spark.read.schema(schema + ", batch long").parquet(path).filter(F.col("batch") != number)
            one = one.join(done.select("query_id").distinct(), "query_id", "left_anti")
        rank(kept(one), docs, k=k).write.mode("overwrite").parquet(folder)

    return queries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
