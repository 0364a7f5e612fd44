"""Ingest of new export files as they arrive, with the batch ingest operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyline.functions.ranking import ranked
from tallyline.operators.ingest import check, errors_of, events_of
from tallyline.sources.billing import with_scope

# Numbers of a batch's rows are below this power of two.
BATCH_PLACES = 40


def ingest_new_files(
    spark: SparkSession,
    exports: str,
    out: str,
    checkpoint: str,
    tenant_id: str,
    project_id: str,
    normalized_at: str,
    lenient: bool = False,
) -> StreamingQuery:
    """Append events and errors of files not seen yet to `out`/events and `out`/errors, then stop.

    `checkpoint` remembers the files done; both it and `out` belong in a shared
    folder. Batches are written with their number, so a repeated batch replaces
    its own output. Events are numbered in the order of arrival: by batch, then as the
    batch reader does, files by name and rows by their place.
    """
    read_from = [F.col(f"_metadata.{c}") for c in ("file_path", "file_block_start")]
    raw = spark.readStream.text(exports).select(F.col("value").alias("raw"), *read_from)

    def write(batch: DataFrame, number: int) -> None:
        row = F.monotonically_increasing_id().alias("row")
        placed = ranked(batch.select("*", row), [], ["file_path", "file_block_start", "row"], "nth")
        arrival = F.shiftleft(F.lit(number).cast("long"), BATCH_PLACES) + F.col("nth")
        scoped = with_scope(placed.select("raw", arrival.alias("ingest_seq")), tenant_id, project_id)
        checked = check(scoped).persist()  # read twice; each row is checked once
        events = events_of(checked, normalized_at, lenient)
        events = events.withColumns({c: F.to_json(c) for c in ("metadata", "raw_payload")})
        events.write.mode("overwrite").parquet(f"{out}/events/batch={number}")
        errors_of(checked).write.mode("overwrite").parquet(f"{out}/errors/batch={number}")
        checked.unpersist()

    return (
        raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
