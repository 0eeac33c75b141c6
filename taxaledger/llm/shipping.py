"""Sending this package's code to the Python workers of a running session."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import taxaledger


#: Rows that Spark hands to Python at once. Texts are long rows: Spark's own
#: default of 10,000 would be some 30 MB for each core, on both sides.
ARROW_ROWS = "1000"


def ship(spark: SparkSession) -> None:
    """Let the workers import the package, as ``--py-files`` would. Once per context."""
    context = spark.sparkContext
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":  # not set by the user
        spark.conf.set(rows, ARROW_ROWS)
    if getattr(context, "_taxaledger_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(taxaledger.__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="taxaledger-code-"), "taxaledger.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("taxaledger", os.path.relpath(path, root)))
    context.addPyFile(archive)
    context._taxaledger_shipped = True
