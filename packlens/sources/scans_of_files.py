"""CSV and ORC scans with a fixed schema; lines that don't fit it are set aside, not read as nulls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

#: The column that holds a damaged line as it stands; null for sound ones.
DAMAGED = "_packlens_damaged"


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = False) -> DataFrame:
    """All lines, with ``DAMAGED``: a line is damaged if a field doesn't read as its type, or fields are missing or too many."""
    reader = spark.read.schema(f"{schema}, {DAMAGED} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", DAMAGED)
    return reader.option("header", header).csv(path)


def sound(rows: DataFrame) -> DataFrame:
    """The sound lines. All fields are read whatever columns are asked for: else a line would count as damaged or not by these."""
    fields = [c for c in rows.columns if c != DAMAGED]
    touched = F.xxhash64(*fields).bitwiseAND(F.lit(0)) == 0  # always true, and needs every field
    return rows.where(F.col(DAMAGED).isNull() & touched).drop(DAMAGED)


def quarantined(rows: DataFrame) -> DataFrame:
    """``file, line`` of the damaged lines, as a written table: it stays when the files go or are mended."""
    held = rows.select("*", F.col("_metadata.file_name").alias("_packlens_file")).where(F.col(DAMAGED).isNotNull())
    return written(held, "quarantine").select(F.col("_packlens_file").alias("file"), F.col(DAMAGED).alias("line"))


def read_orc(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of ORC files under a fixed schema; columns that a file lacks are null. Filters and columns reach the scan."""
    return spark.read.schema(schema).orc(path)
