"""K-mer counts of a stream of reads: each micro-batch adds partial counts to a table, which merge when they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kmerloom.functions import bases as B
from kmerloom.operators import kmers


def count_stream(reads: DataFrame, folder: str, checkpoint: str, k: int = B.K, **trigger: object) -> StreamingQuery:
    """Start counting the streaming reads (column seq) into `folder`, one partial count a batch. A batch that is repeated after a failure replaces itself."""

    def add(batch: DataFrame, number: int) -> None:
        n = kmers.windows(batch, k, []).where("key is not null").groupBy("key").agg(F.count("*").alias("multiplicity"))
        n.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return reads.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def counts_so_far(spark: SparkSession, folder: str) -> DataFrame:
    """(key, multiplicity) of all batches together, no more than 255."""
    return kmers.merged(spark.read.parquet(folder))
