"""New results taken in as they arrive, each only once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KEYS = ("paper_id", "model", "shot")


def ingest_new(stream: DataFrame, table: str, checkpoint: str, keys: tuple[str, ...] = KEYS) -> StreamingQuery:
    """Append to the parquet table what it doesn't hold yet: an anti-join for each micro-batch on the keys.

    Every batch writes a folder of its own, named by its number, so a batch that is run again after a lost executor
    replaces what it wrote before. Repeated rows within a batch count once.
    """

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(list(keys))
        held = _held(spark, table, number, fresh)
        if held is not None:
            fresh = fresh.join(held.select(*keys), list(keys), "left_anti")
        fresh.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _held(spark: SparkSession, table: str, number: int, like: DataFrame) -> DataFrame | None:
    """What earlier batches wrote."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    kind = like.schema.jsonValue()
    from pyspark.sql.types import IntegerType, StructType

    return spark.read.schema(StructType.fromJson(kind).add("batch", IntegerType())).parquet(table).where(F.col("batch") != number)


def error_rates(stream: DataFrame, at: str = "created_at", size: str = "1 day", late: str = "7 days") -> DataFrame:
    """Runs and errors in windows of time, closed when ``late`` has passed; later rows are left out."""
    return (
        stream.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), "model")
        .agg(F.count("*").alias("n_runs"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("n_errors"))
        .select(F.col("w.start").alias("start"), "model", "n_runs", "n_errors")
    )
