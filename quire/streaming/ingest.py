"""Resumable ingestion of result documents: each file is processed once, a rerun adds only new files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import RESULT


def ingest_results(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int = 1000) -> int:
    """Pages of all new ``*_results.json`` under ``source`` appended to ``target``; the pages that were added.

    The checkpoint keeps what was read; the sink's own commit log makes every batch appear once even if it is retried.
    """
    stream = (
        spark.readStream.schema(f"{RESULT}, _corrupt_record STRING").option("multiLine", "true").option("pathGlobFilter", "*_results.json")
        .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).json(source)
    )
    good = stream.where("_corrupt_record is null").withColumn("file", F.col("_metadata.file_name"))
    pages = good.select("file", "source_pdf", F.posexplode("pages").alias("pos", "page")).select("file", "source_pdf", (F.col("pos") + 1).alias("pos"), "page.*")
    query = pages.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(int(p["numInputRows"]) for p in query.recentProgress)


def file_states(spark: SparkSession, pages: str) -> DataFrame:
    return spark.read.parquet(pages).groupBy("file").agg(F.count("*").alias("pages"), F.lit("processed").alias("state"))
