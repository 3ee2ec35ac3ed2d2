"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts have it: space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the cluster's ``spark.checkpoint.dir``. Only where that is unset, as
    in local tests, a temporary folder is made and remembered in the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="packlens-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; Spark deletes it when the session's JVM ends."""
    path = f"{shared_dir(spark)}/packlens-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: cuts lineage, survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return kept_at(df.sparkSession.read.schema(df.schema).parquet(path), path)


def kept_at(table: DataFrame, path: str) -> DataFrame:
    table.packlens_path = path
    return table


def free(*tables: DataFrame) -> None:
    """Delete what ``materialize`` or ``bucketed`` wrote; for tables of which nothing that isn't written itself depends any more."""
    for table in tables:
        if path := getattr(table, "packlens_path", None):
            spark = table.sparkSession
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Buckets of a table at most; Spark itself refuses over 100,000.
MOST_BUCKETS = 50_000


def bucketed(df: DataFrame, path: str, buckets: int, by: list[str], sort: bool = False) -> DataFrame:
    """Write ``df`` to ``path`` in the shared folder as a table bucketed (and sorted) by columns and read it back.

    Grouping by ``by``, or joining with a table of as many buckets, shuffles no row
    of it. What was grouped by ``by`` in as many partitions gives one file a bucket,
    which is read in order; other rows are written where they are.
    """
    buckets = min(buckets, MOST_BUCKETS)
    writer = df.write.format("parquet").option("path", path).option("parquet.enable.dictionary", "false").bucketBy(buckets, *by)  # of hashes no dictionary can be made
    table = f"packlens_{uuid.uuid4().hex}"
    (writer.sortBy(*by) if sort else writer).saveAsTable(table)
    return kept_at(df.sparkSession.table(table), path)


def reopened(spark: SparkSession, path: str, schema: str, buckets: int, by: list[str]) -> DataFrame:
    """A table that ``bucketed`` wrote to ``path`` sorted, perhaps in another session."""
    table, columns = f"packlens_{uuid.uuid4().hex}", ", ".join(by)
    spark.sql(f"CREATE TABLE {table} ({schema}) USING parquet CLUSTERED BY ({columns}) SORTED BY ({columns}) INTO {min(buckets, MOST_BUCKETS)} BUCKETS LOCATION '{path}'")
    return kept_at(spark.table(table), path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def count_words(text: Column) -> Column:
    """Number of words of ``text`` (null: 0), on the JVM."""
    marks = F.regexp_replace(text, r"[^\x20\x09-\x0D]++", "x")
    return F.coalesce(F.length(F.translate(marks, " \t\n\x0b\f\r", "")), F.lit(0)).cast("long")


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about ``max_bytes`` of ``column`` (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > max_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; a null is an empty text."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
