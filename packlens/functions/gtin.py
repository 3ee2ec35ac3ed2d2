"""Bar-code numbers: check digits, formats, prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixed
from .text import lookup, strip


def digits_of(code: Column) -> Column:
    return F.regexp_replace(code, "[^0-9]", "")


def check_digit(body: Column) -> Column:
    """GS1 mod-10 digit of a body: weights 3, 1, 3, ... from its right end."""
    def add(total: Column, i: Column) -> Column:
        return total + F.substring(F.reverse(body), i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 3).otherwise(1)

    total = F.aggregate(F.sequence(F.lit(1), F.length(body)), F.lit(0), add)
    return F.when(F.length(body) > 0, (10 - total % 10) % 10)


def format_name(digits: Column) -> Column:
    return lookup(fixed.GTIN_NAMES, F.length(digits))


def checks(digits: Column) -> Column:
    """Whether the last digit is the check digit of the others; false for lengths that no GTIN has."""
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    right = check_digit(body) == F.substring(digits, F.length(digits), F.lit(1)).cast("int")
    return F.when(format_name(digits).isNotNull(), right).otherwise(F.lit(False))


def symbol_is_valid(code: Column, kind: Column) -> Column:
    """Validity by symbology: check digit for EAN-13 and UPC-A, not empty for QR, Code 128 and Code 39, true for all else."""
    k = F.upper(F.coalesce(kind, F.lit("")))
    digits = digits_of(code)
    ean = k.contains("EAN13") | (k.contains("EAN") & (F.length(code) == 13))
    upc = k.contains("UPCA") | (k.contains("UPC") & (F.length(code) == 12))
    other = k.contains("QR") | k.contains("CODE128") | k.contains("CODE39")
    return F.when(ean, (F.length(digits) == 13) & checks(digits)).when(upc, (F.length(digits) == 12) & checks(digits)).when(other, F.length(code) > 0).otherwise(F.lit(True))


def range_table(spark: SparkSession, ranges: list[tuple[int, int, str]], value: str) -> DataFrame:
    """``prefix, value``: ranges spread to one row a prefix (1,000 at most), the first range winning, for an equi-join."""
    first: dict[int, str] = {}
    for low, high, text in ranges:
        for prefix in range(low, high + 1):
            first.setdefault(prefix, text)
    return spark.createDataFrame(sorted(first.items()), f"prefix int, {value} string")


def with_scanner_economy(codes: DataFrame, code: str = "code") -> DataFrame:
    """Adds ``economy`` by the first three digits as they stand; null under three digits."""
    table = F.broadcast(range_table(codes.sparkSession, fixed.PREFIX_ECONOMIES, "economy"))
    digits = digits_of(F.col(code))
    keyed = codes.withColumn("_prefix", F.when(F.length(digits) >= 3, F.substring(digits, 1, 3).cast("int")))
    return keyed.join(table, F.col("_prefix") == F.col("prefix"), "left").drop("_prefix", "prefix")


def classified(codes: DataFrame, code: str = "code") -> DataFrame:
    """Adds the struct ``gtin`` with all facts that the number itself holds.

    The prefix is read from the zero-padded 14-digit form; GTIN-8 and other
    lengths have none. Two joins with fixed tables of at most 1,000 rows.
    """
    spark = codes.sparkSession
    digits = F.col("_digits")
    padded = F.when(F.col("_format").isNotNull(), F.lpad(digits, 14, "0"))
    keyed = codes.withColumn("_raw", strip(F.col(code))).withColumn("_digits", F.coalesce(digits_of(F.col("_raw")), F.lit(""))).withColumn("_format", format_name(digits))
    keyed = keyed.withColumn("_padded", padded).withColumn("_prefix", F.when(F.length(digits) != 8, F.substring(padded, 2, 3)))
    economies = F.broadcast(range_table(spark, fixed.PREFIX_ECONOMIES, "_economy").withColumnRenamed("prefix", "_p1"))
    reserved = F.broadcast(range_table(spark, fixed.RESERVED_PREFIXES, "_reason").withColumnRenamed("prefix", "_p2"))
    number = F.col("_prefix").cast("int")
    joined = keyed.join(economies, number == F.col("_p1"), "left").join(reserved, number == F.col("_p2"), "left")
    right = checks(digits)
    is_length, restricted = F.col("_format").isNotNull(), F.col("_reason").isNotNull()
    india = F.coalesce(F.col("_prefix") == fixed.INDIA_PREFIX, F.lit(False))
    notes = F.filter(
        F.array(
            F.when(~is_length, F.format_string(fixed.NOTE_LENGTH, F.length(digits))).when(~right, F.lit(fixed.NOTE_CHECK)),
            F.when(restricted, F.format_string(fixed.NOTE_RESERVED, F.col("_prefix"), F.col("_reason"))),
            F.when(india, F.lit(fixed.NOTE_INDIA)),
        ), lambda x: x.isNotNull())
    facts = F.struct(
        F.col("_raw").alias("raw"), digits.alias("digits"), F.length(digits).alias("length"), F.col("_format").alias("format"),
        is_length.alias("is_gtin_length"), right.alias("checksum_valid"), F.col("_prefix").alias("prefix"), F.col("_economy").alias("country"),
        india.alias("is_india"), restricted.alias("is_restricted"), F.col("_reason").alias("restricted_reason"), F.col("_padded").alias("gtin14"),
        (is_length & right & ~restricted).alias("is_valid"), notes.alias("notes"),
    )
    return joined.withColumn("gtin", facts).drop("_raw", "_digits", "_format", "_padded", "_prefix", "_economy", "_reason", "_p1", "_p2")
