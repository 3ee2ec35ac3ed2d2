"""Report sinks that can be written again: a batch replaces itself, whatever was written of it before.

A document is indented over several lines, so documents are set apart by a record
separator (as in JSON text sequences), not by line ends.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATOR = "\x1e"


def write_documents(reports: DataFrame, folder: str, batch_id: int = 0, column: str = "report") -> None:
    """Write ``reports(column)`` as batch ``batch_id`` of a folder; the same batch again leaves one copy.

    Partition overwrite: only the batch's own partition is replaced, when all of the new one is there.
    """
    held = reports.where(F.col(column).isNotNull()).select(F.lit(int(batch_id)).alias("batch"), F.col(column).alias("value"))
    writer = held.write.mode("overwrite").partitionBy("batch").option("partitionOverwriteMode", "dynamic").option("lineSep", SEPARATOR)
    writer.text(folder)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``batch, report`` of a folder of ``write_documents``."""
    schema = "value string, batch long"
    return spark.read.schema(schema).option("lineSep", SEPARATOR).text(folder).select("batch", F.col("value").alias("report"))


def document_writer(folder: str, column: str = "report") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: a batch that is replayed after a failure replaces what it wrote."""
    return lambda reports, batch_id: write_documents(reports, folder, batch_id, column)
