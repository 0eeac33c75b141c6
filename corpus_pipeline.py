"""A training corpus from raw documents, in five stages.

1. quality: documents that the quality network rejects go.
2. near_duplicates: one document of each near-duplicate class stays.
3. decontamination: documents that share a window with a benchmark item go.
4. secrets: the spans that the secret scan finds are replaced in the text.
5. encoding: each text becomes token ids; counts and digests come back.

Each stage works on all rows its predecessor kept. All but the last return the
columns of their input. Null and empty texts pass where a stage finds nothing
in them; a null doc_id is no reason to go.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxaledger.llm import bpe_codec, near_duplicates, quality_cnn, secret_scan, winnowing
from taxaledger.llm.shipping import ship
from taxaledger.llm.texts import table
from taxaledger.session import write_stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(fn: Stage) -> Stage:
    @functools.wraps(fn)
    def shipped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, docs, sf_dir)

    return shipped


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a unique number that a second reading sees again."""
    name = "_row"
    while name in docs.columns:
        name += "_"
    return write_stage(docs.withColumn(name, F.monotonically_increasing_id())), name


def _without(rows: DataFrame, number: str, dropped: DataFrame) -> DataFrame:
    gone = write_stage(dropped.select(F.col("rid").alias(number)))
    return rows.join(gone, number, "left_anti").drop(number)


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = quality_cnn.train(docs, table(spark, sf_dir, "labels"))
    scored = quality_cnn.score(docs, net, keep=tuple(docs.columns))
    return scored.filter(F.col("_score") >= quality_cnn.THRESHOLD).drop("_score")


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, number = _numbered(docs)
    return _without(rows, number, near_duplicates.near_duplicates(rows, row_col=number).filter(~F.col("kept")))


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, number = _numbered(docs)
    found = winnowing.contaminated_spans(rows, table(spark, sf_dir, "benchmark"), row_col=number)
    return _without(rows, number, found.filter(F.size("spans") > 0))


@_stage
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(docs, keep=tuple(docs.columns)).withColumn("_masked", secret_scan.masked())
    clean = F.when(F.size("spans") == 0, F.col(f"_keep{docs.columns.index('text')}")).otherwise(F.col("_masked"))
    out = []
    for i, c in enumerate(docs.columns):
        if c == "text":
            out.append(clean.alias(c))
        elif c == "n_chars":
            out.append(F.when(F.size("spans") == 0, F.col(f"_keep{i}")).otherwise(F.length("_masked")).cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col(f"_keep{i}").alias(c))
    return found.select(*out)


@_stage
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_dedup),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("encoding", encoding),
]

#: SQL can express neither the network nor the near-duplicate classes; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = write_stage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
