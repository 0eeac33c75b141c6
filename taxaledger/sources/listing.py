"""Files a scan leaves out: Spark plans no task for a file without bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def empty_files(scan: DataFrame, seen: DataFrame, column: str) -> DataFrame:
    """``column`` of the files the scan lists that gave no row to ``seen``.

    Only file names pass through the driver, which lists them for the scan
    anyway. The two spellings of a path meet without their scheme.
    """
    spark = scan.sparkSession

    def plain(c):
        return F.regexp_replace(c, "^[a-z0-9]+:/*", "/")

    listed = spark.createDataFrame([(f,) for f in scan.inputFiles()], f"{column} string")
    had = seen.select(plain(F.col(column)).alias("_p")).distinct()
    return listed.withColumn("_p", plain(F.col(column))).join(had, "_p", "left_anti").select(column)
