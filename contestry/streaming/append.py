"""File-stream form of the validated append: every micro-batch takes the batch path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from contestry.operators.append import process_append
from contestry.operators.validate import RAW_COLUMNS, Contract, split, with_reasons
from contestry.session import Stage
from contestry.sources.files import write_quarantine


def raw_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    schema = StructType([StructField(c, StringType()) for c in RAW_COLUMNS])
    return (
        spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files_per_batch)
        .option("enforceSchema", False).csv(folder)
    )


def append_stream(spark: SparkSession, folder: str, base: str, checkpoint: str, contract: Contract = Contract(), quarantine: str | None = None, clean=None) -> StreamingQuery:
    """Append the contests of newly arrived files.

    A batch that is delivered again after a failure finds its rows stored and adds nothing, so the
    natural key makes the sink idempotent. With ``quarantine`` the rejected rows of a batch are set
    aside and the rest goes on; without it a bad row stops the stream.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = batch
        if quarantine is not None:
            checked = Stage(batch.sparkSession, "batch").write(with_reasons(batch, contract), "rows")
            write_quarantine(split(checked)[1], f"{quarantine}/batch={batch_id}")
            rows = checked.where("size(reasons) = 0").select(*RAW_COLUMNS)
        process_append(batch.sparkSession, base, rows, contract, dry_run=False, clean=clean)

    return (
        raw_stream(spark, folder).writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
