"""The raw-record ingest as an incremental job.

Each run picks up the files that arrived since the last one, merges them into the
partitioned tree and stops; progress lives in the checkpoint folder.  A batch that is
repeated after a failure replaces its own records, so nothing is counted twice.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from pricewell.sources.prices import ingest_rows, raw_reader


def ingest_new_files(
    spark: SparkSession, raw_dir: str, root: str, progress_dir: str, fmt: str = "json", quarantine: str | None = None,
) -> None:
    """Ingest all new files once and wait for the end."""
    query = (
        raw_reader(spark.readStream, fmt).load(raw_dir).writeStream
        .foreachBatch(lambda batch, _: ingest_rows(batch, root, "merge", quarantine))
        .option("checkpointLocation", progress_dir)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
