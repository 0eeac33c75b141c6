"""Name sources: reference tables that can answer a scientific name."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import match_key
from ..session import run_folder

CHECKLIST = "checklist"
BACKBONE = "backbone"

CHECKLIST_COLUMNS = (
    "species", "scientificName", "taxonomicStatus", "id", "kingdom", "phylum",
    "class", "order", "family", "genus", "taxonRank", "vernacularName",
    "origin", "endemism", "states", "biome",
)
BACKBONE_COLUMNS = (
    "usageKey", "acceptedUsageKey", "canonicalName", "scientificName", "status",
    "rank", "kingdom", "phylum", "class", "order", "family", "genus", "authorship",
)


@dataclass(frozen=True)
class NameSource:
    """One reference table and how to read it.

    ``kind`` is a *checklist* (has an exact index, so fuzzy matching waits until
    no other source holds the name) or a *backbone* (asked for every name that
    is still open). ``accepted_column`` enables the accepted-name lookup,
    ``distribution`` the state/biome lookup. ``status_words`` maps the words of
    the source's status column to accepted / synonym / ambiguous where they
    differ from the usual ones.
    """

    id: str
    label: str
    kind: str
    priority: int
    table: DataFrame
    default_kingdom: str | None = None
    accepted_column: str | None = None
    distribution: bool = False
    version: str | None = None
    status_words: dict[str, str] = field(default_factory=dict)
    max_distance: float = 0.1


def status_meaning(source: NameSource, status: Column) -> Column:
    """What a status word of a checklist means, in lower case: one of the usual
    words (``valid`` reads accepted), or what the source says of its own words;
    a word that it does not define means nothing."""
    word = F.lower(status)
    if not source.status_words:
        return F.when(word == "valid", "accepted").otherwise(word)
    out = F.lit(None).cast("string")
    for own, meaning in source.status_words.items():
        out = F.when(word == own.lower(), meaning).otherwise(out)
    return out


def _with_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    return df.select("*", *[F.lit(None).cast("string").alias(c) for c in missing])


def read_base(df: DataFrame) -> DataFrame:
    """A checklist restricted to rows with a species, with its match key.

    Rows of higher ranks have no species and could never match. ``seq`` is the
    row order of the source; where a table has none, its content decides.
    """
    df = df.where(F.col("species").isNotNull())
    if "seq" not in df.columns:
        df = df.withColumn("seq", F.xxhash64(*[F.col(c) for c in sorted(df.columns)]))
    return _with_columns(df, CHECKLIST_COLUMNS).withColumn("mk", match_key("species"))


def read_backbone(df: DataFrame) -> DataFrame:
    return _with_columns(df, BACKBONE_COLUMNS).withColumn("mk", match_key("canonicalName"))


def store(source: NameSource, buckets: int | None = None) -> NameSource:
    """The source on a table of its own, in buckets by match key and sorted by it.

    Its rows are read, and their keys made, once. A join or an aggregate on the
    key then needs no exchange on this side, whatever asks the source. The
    default number of buckets is that of shuffle partitions, so the other
    side's exchange fits it. The table's files lie with the other intermediate
    tables and go with them (``session.drop_stages``).
    """
    spark = source.table.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"base_{uuid.uuid4().hex}"
    # Rows of a bucket in one task first: else each task would write a file for each bucket.
    rows = source.table.repartition(n, "mk")
    rows.write.option("path", f"{run_folder(spark)}/{name}").bucketBy(n, "mk").sortBy("mk").saveAsTable(name)
    return replace(source, table=spark.table(name))


def _reason(error: Exception) -> str:
    return next((line for line in str(error).splitlines() if line.strip()), type(error).__name__)


def store_sources(sources: Iterable[NameSource]) -> tuple[list[NameSource], list[tuple[str, str]]]:
    """Stored sources in priority order, and ``(id, error)`` of those that cannot be read.

    A source may open and still fail while its rows are read, on some executor
    in the middle of a job. Read here, each in a job of its own, it is skipped
    and reported, and the others' answers stay. The jobs are handed in
    together, so small sources do not wait for each other.
    """
    def attempt(source: NameSource) -> NameSource | tuple[str, str]:
        try:
            return store(source)
        except Exception as error:  # noqa: BLE001 - any failure means "skip this one"
            return source.id, _reason(error)

    ordered = in_priority(sources)
    with ThreadPoolExecutor(max(1, len(ordered))) as pool:
        got = list(pool.map(attempt, ordered))
    return [s for s in got if isinstance(s, NameSource)], [s for s in got if not isinstance(s, NameSource)]


def checklist(id: str, label: str, priority: int, df: DataFrame, **options) -> NameSource:
    return NameSource(id, label, CHECKLIST, priority, read_base(df), **options)


def backbone(id: str, label: str, priority: int, df: DataFrame, **options) -> NameSource:
    return NameSource(id, label, BACKBONE, priority, read_backbone(df), **options)


def in_priority(sources: Iterable[NameSource]) -> list[NameSource]:
    return sorted(sources, key=lambda s: s.priority)


def load_sources(
    spark: SparkSession, makers: dict[str, Callable[[SparkSession], NameSource]]
) -> tuple[list[NameSource], DataFrame]:
    """Open every source; one that fails is skipped and reported, not fatal."""
    held, failures = [], []
    for name, make in makers.items():
        try:
            source = make(spark)
            source.table.schema  # a missing path or column shows here
            held.append(source)
        except Exception as error:  # noqa: BLE001 - any failure means "skip this one"
            failures.append((name, _reason(error)))
    report = spark.createDataFrame(failures, "provider string, error string")
    return in_priority(held), report
