"""Readers: image folders, data URLs. Writers are in ``sinks``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGES = ("jpg", "jpeg", "png", "webp", "bmp", "tiff", "tif")


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """The image files of a folder: path, length, modificationTime, content; chosen by ending."""
    return spark.read.format("binaryFile").load(folder).where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*IMAGES))


def from_data_url(value: Column) -> Column:
    """The bytes of base64 text, with or without a ``data:...,`` prefix; null if it isn't base64."""
    return F.try_to_binary(F.substring_index(value, ",", -1), F.lit("base64"))
