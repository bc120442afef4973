"""Labelled pages: JSON files of recognised words with their corner points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "Images struct<identifier: string, width: int, height: int, form_type: string>, bbox array<struct<data: string, x: array<int>, y: array<int>>>, _corrupt_record string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Tokens of every readable file under the path; files that aren't JSON are skipped, so are words without text or with one point."""
    raw = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(path).where("_corrupt_record IS NULL")
    words = raw.select("Images.*", F.posexplode("bbox").alias("idx", "b"))
    clean = words.withColumn("text", F.trim("b.data")).where((F.col("text") != "") & (F.size("b.x") >= 2) & (F.size("b.y") >= 2))
    return clean.select(
        F.col("identifier").alias("document_id"), "form_type", "width", "height", "idx", "text", F.array_min("b.x").alias("x_min"), F.array_min("b.y").alias("y_min"),
        F.array_max("b.x").alias("x_max"), F.array_max("b.y").alias("y_max"), F.lit(1.0).alias("confidence"),
    )
