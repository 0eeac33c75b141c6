"""The contract every source answer is brought to: 21 columns, one meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import name_parts
from ..functions.status import status_rank
from ..functions.text import filled_or, is_filled
from ..schema import CANONICAL_COLUMNS, CANONICAL_SCHEMA, SUPRA_GENERIC_RANKS


def ensure_columns(df: DataFrame, columns) -> DataFrame:
    """Add the missing columns as null text."""
    missing = [c for c in dict.fromkeys(columns) if c not in df.columns]
    return df.select("*", *[F.lit(None).cast("string").alias(c) for c in missing])


def empty_result(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CANONICAL_SCHEMA)


def canonical_rows(df: DataFrame, provider: str | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """Bring a partial answer to the canonical schema.

    ``provider`` overwrites the provider column when given; ``extra`` columns
    ride along behind the 21.
    """
    df = ensure_columns(df, CANONICAL_COLUMNS)
    who = F.lit(provider).cast("string") if provider is not None else F.col("provider").cast("string")
    status = F.col("validation_status").cast("string")
    status = F.when(status.isNull() | (status == ""), "not_found").otherwise(status)
    text = [c for c in CANONICAL_COLUMNS if c != "match_count"]
    df = df.select(
        *[F.col(c).cast("string").alias(c) for c in text
          if c not in ("provider", "validation_status", "scientificName")],
        F.col("match_count").try_cast("int").alias("_count"),
        who.alias("provider"),
        status.alias("validation_status"),
        filled_or(F.col("scientificName").cast("string"), F.col("query_name")).alias("scientificName"),
        *extra,
    )
    df = df.withColumn("_parts", name_parts("scientificName"))
    supra = F.coalesce(F.lower("taxonRank").isin(*SUPRA_GENERIC_RANKS), F.lit(False))
    parts = F.col("_parts")
    derived = {
        "match_count": F.coalesce("_count", (F.col("validation_status") != "not_found").cast("int")),
        "genus": filled_or("genus", F.when(~supra, parts["genus"])),
        "specificEpithet": filled_or("specificEpithet", parts["specificEpithet"]),
        "infraspecificEpithet": filled_or("infraspecificEpithet", parts["infraspecificEpithet"]),
        "taxonRank": F.lower(filled_or("taxonRank", parts["taxonRank"])),
    }
    return df.select(
        *[derived[c].alias(c) if c in derived else F.col(c) for c in CANONICAL_COLUMNS], *extra
    )


def placeholder_rows(names: DataFrame, status: str = "not_found") -> DataFrame:
    """Rows for names that no source answered."""
    return canonical_rows(
        names.select("query_name", F.lit(status).alias("validation_status"))
    )


def best_row_per_name(rows: DataFrame, order: tuple[str, ...] = ("provider_ord", "seq")) -> DataFrame:
    """One row per name out of stacked answers.

    The best status wins; among equals the last row in source order wins.
    """
    key = status_rank("validation_status", "taxonomicStatus")
    ranked = rows.withColumn("_rank", key)
    packed = ranked.groupBy("query_name").agg(
        F.max_by(
            F.struct(*[c for c in rows.columns if c != "query_name" and c not in order]),
            F.struct("_rank", *order),
        ).alias("_row")
    )
    columns = [c for c in rows.columns if c not in order]
    return packed.select("query_name", "_row.*").select(*columns)


def check_source(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Conformance report of a source: one row per rule with its violations."""
    statuses = ("accepted", "synonym", "ambiguous", "not_found")
    spark = rows.sparkSession
    schema_gap = len(set(CANONICAL_COLUMNS) ^ set(rows.columns))
    bad_status = rows.where(~F.col("validation_status").isin(*statuses) | F.col("validation_status").isNull())
    foreign = rows.join(asked.select("query_name"), "query_name", "left_anti")
    repeated = rows.groupBy("query_name").count().where(F.col("count") > 1)
    blank = rows.where(~is_filled("query_name"))

    def line(rule: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(rule).alias("rule"), "violations")

    schema_line = spark.range(1).select(
        F.lit("schema").alias("rule"), F.lit(schema_gap).cast("long").alias("violations")
    )
    return (
        schema_line.unionByName(line("status", bad_status))
        .unionByName(line("only_asked_names", foreign))
        .unionByName(line("one_row_per_name", repeated))
        .unionByName(line("named", blank))
    )
