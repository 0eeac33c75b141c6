"""Resolve names against prioritized sources.

Exact keys come first: every source's exact answer is one left join on the match
key, so the whole first pass is one shuffle of the distinct names. Names that no
source accepted go to one edit-distance join against all sources at once. Which
source was entitled to answer, and which answer wins, is then decided per row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import normalize_name
from ..functions.status import status_rank
from ..functions.text import is_filled, match_key
from ..operators.answers import (
    apply_verdict, backbone_parents, backbone_verdict, checklist_verdict, exact_rows,
)
from ..operators.canonical import canonical_rows, placeholder_rows
from ..operators.nearest import fuzzy_best
from ..schema import CANONICAL_COLUMNS
from ..session import write_stage
from ..sources.bases import BACKBONE, CHECKLIST, NameSource, in_priority, store_sources


def distinct_names(df: DataFrame, name_col: str = "scientificName") -> DataFrame:
    """Normalized, named and distinct; raw names are made distinct first."""
    # Written once, so that no test on the normalized name can be moved back in
    # front of the distinct step, onto every record.
    raw = write_stage(df.select(F.col(name_col).alias("_raw")).distinct())
    names = write_stage(raw.select(normalize_name("_raw").alias("query_name")))
    return names.where(F.col("query_name").isNotNull()).distinct()


def source_failures(spark: SparkSession, failures: Sequence[tuple[str, str]]) -> DataFrame:
    """``provider, error`` of the sources that could not be asked."""
    return spark.createDataFrame(list(failures), "provider string, error string")


def resolve_with_failures(names: DataFrame, sources: Sequence[NameSource], fuzzy: bool = True) -> tuple[DataFrame, DataFrame]:
    """The answers of the sources that can be read, and the failures of the others."""
    held, failures = store_sources(sources)
    return resolve_names(names, held, fuzzy), source_failures(names.sparkSession, failures)


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _candidate(asked: Column, verdict: Column, row: Column, place: int, number: int) -> Column:
    """A comparable candidate: best status first, then the later source."""
    rank = status_rank(verdict["status"], row["taxonomicStatus"])
    return F.when(
        asked,
        F.struct(rank.alias("rank"), F.lit(place).alias("place"), F.lit(number).alias("number"), verdict.alias("v")),
    )


@dataclass(frozen=True)
class _FirstPass:
    """Names with every source's exact row ``e``, parent row ``p`` and verdict ``v``, and who is asked when."""

    state: DataFrame
    held: list[Column]
    asked_first: list[Column]
    asked_second: list[Column]
    ask: Column


def _first_pass(names: DataFrame, sources: Sequence[NameSource]) -> _FirstPass:
    """``sources`` in priority order; ``names`` has ``query_name``."""
    state = names.withColumn("mk", match_key("query_name"))
    for i, s in enumerate(sources):
        state = state.join(exact_rows(s).withColumnRenamed("row", f"e{i}"), "mk", "left")
    state = state.withColumn("_genus", match_key(F.substring_index("query_name", " ", 1)))
    for i, s in enumerate(sources):
        if s.kind == BACKBONE:
            parents = backbone_parents(s).select(F.col("mk").alias("_genus"), F.col("row").alias(f"p{i}"))
            state = state.join(parents, "_genus", "left")

    query = F.col("query_name")
    # Verdicts of the exact rows, bound to columns: they are read many times.
    state = state.select("*", *[
        (backbone_verdict(query, F.col(f"e{i}"), F.lit("EXACT")) if s.kind == BACKBONE
         else checklist_verdict(query, F.col(f"e{i}"), "Correct", True, s)).alias(f"v{i}")
        for i, s in enumerate(sources)
    ])
    held = [F.col(f"e{i}").isNotNull() for i in range(len(sources))]
    accepted = [held[i] & (F.col(f"v{i}.status") == "accepted") for i in range(len(sources))]

    # First pass: a checklist is asked for the names it holds, a backbone for
    # every name still open. Only an accepted answer closes a name.
    asked_first = [
        (held[i] if s.kind == CHECKLIST else F.lit(True)) & ~_any(accepted[:i])
        for i, s in enumerate(sources)
    ]
    # Second pass: a checklist guesses only names that neither it nor a later
    # checklist holds.
    asked_second = [
        ~held[i] & ~_any(accepted)
        & ~_any([held[j] for j in range(i + 1, len(sources)) if sources[j].kind == CHECKLIST])
        if s.kind == CHECKLIST else F.lit(False)
        for i, s in enumerate(sources)
    ]
    guesses = [
        asked_second[i] if s.kind == CHECKLIST else asked_first[i] & ~held[i]
        for i, s in enumerate(sources)
    ]
    ask = reduce(
        lambda a, b: a.bitwiseOR(b),
        [F.when(g, 1 << i).otherwise(0) for i, g in enumerate(guesses)],
    ).cast("int")
    return _FirstPass(state, held, asked_first, asked_second, ask)


def guessed_names(names: DataFrame, sources: Sequence[NameSource]) -> DataFrame:
    """``query_name, ask``: the names that some source guesses at, with a bit per source in priority order."""
    first = _first_pass(names.where(is_filled("query_name")).select("query_name"), in_priority(sources))
    # Written, so that keeping the open names does not work out every verdict twice.
    return write_stage(first.state.select("query_name", first.ask.alias("ask"))).where("ask <> 0")


def resolve_names(names: DataFrame, sources: Sequence[NameSource], fuzzy: bool = True) -> DataFrame:
    """One canonical row per name of ``names`` (column ``query_name``, distinct)."""
    sources = in_priority(sources)
    names = names.where(is_filled("query_name")).select("query_name")
    if not sources:
        return placeholder_rows(names)
    first = _first_pass(names, sources)
    state, held, asked_first, asked_second = first.state, first.held, first.asked_first, first.asked_second
    query = F.col("query_name")

    if fuzzy:
        # Read twice below (to ask, and to join the answers back).
        state = write_stage(state)
        open_names = state.select("query_name", first.ask.alias("ask")).where("ask <> 0")
        best = fuzzy_best(open_names, sources)
        answers = best.groupBy("query_name").agg(
            *[
                F.min_by(F.when(F.col("src") == i, F.col("row")), F.when(F.col("src") == i, F.col("src"))).alias(f"f{i}")
                for i in range(len(sources))
            ]
        )
        state = state.join(answers, "query_name", "left")
    else:
        row_type = state.schema["e0"].dataType
        state = state.select("*", *[F.lit(None).cast(row_type).alias(f"f{i}") for i in range(len(sources))])

    # Guesses and parents get their verdicts; then every candidate is complete.
    guessed = []
    for i, s in enumerate(sources):
        near = F.col(f"f{i}")
        if s.kind == CHECKLIST:
            guessed.append(checklist_verdict(query, near, "Probably_incorrect", exact=False).alias(f"w{i}"))
        else:
            row = F.coalesce(F.col(f"e{i}"), near, F.col(f"p{i}"))
            kind = F.when(held[i], "EXACT").when(near.isNotNull(), "FUZZY").when(
                F.col(f"p{i}").isNotNull(), "HIGHERRANK").otherwise("NONE")
            guessed += [row.alias(f"r{i}"), backbone_verdict(query, row, kind).alias(f"w{i}")]
    state = state.select("*", *guessed)

    candidates, rows = [], []
    for i, s in enumerate(sources):
        if s.kind == CHECKLIST:
            for asked, verdict, row in ((asked_first[i], "v", "e"), (asked_second[i], "w", "f")):
                candidates.append(_candidate(asked, F.col(f"{verdict}{i}"), F.col(f"{row}{i}"), i, len(rows)))
                rows.append(F.col(f"{row}{i}"))
        else:
            # A name the backbone does not know at all is still answered.
            candidates.append(_candidate(asked_first[i], F.col(f"w{i}"), F.col(f"r{i}"), i, len(rows)))
            rows.append(F.col(f"r{i}"))
    best = F.greatest(*candidates) if len(candidates) > 1 else candidates[0]
    chosen = state.select("query_name", *[c for c in state.columns if c[0] in "efr" and c[1:].isdigit()], best.alias("_best"))
    row = reduce(
        lambda a, k: F.when(F.col("_best.number") == k, rows[k]).otherwise(a), range(1, len(rows)), rows[0]
    )
    provider = F.get(F.array(*[F.lit(s.id) for s in sources]), F.col("_best.place"))
    chosen = chosen.select("query_name", F.col("_best.v").alias("v"), provider.alias("provider"), row.alias("row"))
    values = apply_verdict(query, F.col("row"), F.col("v"))
    out = chosen.select(
        "query_name", "provider", F.col("v.status").alias("validation_status"),
        *[c.alias(f) for f, c in values.items()],
    )
    return canonical_rows(out).select(*CANONICAL_COLUMNS)
