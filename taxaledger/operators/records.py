"""Write name-level answers back onto records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import normalize_name, typed_authorship
from ..functions.status import is_prefilled
from ..functions.text import filled_or, is_filled, trimmed
from ..schema import FILL_COLUMNS, NAME_COLUMNS, REPLACED_SOURCES
from ..session import write_stage
from .joins import hot_keys, lookup_join
from .threat import apply_threatened_status


def unvalidated_names(records: DataFrame, name_col: str = "scientificName") -> DataFrame:
    """Typed names of the records that still need resolution."""
    return records.where(~is_prefilled(records.columns)).select(name_col)


def name_weights(records: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row per distinct key of the records, and how much hangs on it.

    ``n`` counts the records (it tells which keys are hot), ``seq`` and
    ``new_seq`` are the first record and the first not yet validated record.
    """
    fresh = ~is_prefilled(records.columns)
    return records.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(seq).alias("seq"),
        F.min(F.when(fresh, F.col(seq))).alias("new_seq"),
    )


def parsed_names(pairs: DataFrame) -> DataFrame:
    """``scientificName, seq, new_seq, query_name``: each typed name of ``name_weights`` rows, parsed once.

    Written, so that no test on the parsed name makes a plan parse it again.
    """
    typed = pairs.groupBy("scientificName").agg(F.min("seq").alias("seq"), F.min("new_seq").alias("new_seq"))
    return write_stage(typed.withColumn("query_name", normalize_name("scientificName")))


def names_to_resolve(parsed: DataFrame) -> DataFrame:
    """``query_name``: the distinct names of ``parsed_names`` rows with a record not yet validated."""
    return parsed.where(F.col("new_seq").isNotNull() & is_filled("query_name")).select("query_name").distinct()


def answers_for(weights: DataFrame, cascade: DataFrame, threatened: DataFrame | None = None,
                invasive: DataFrame | None = None, flags: DataFrame | None = None,
                name_col: str = "scientificName") -> DataFrame:
    """Everything known about each distinct record key, as one table.

    ``weights`` has ``name_col`` (and ``area`` when ``flags`` is given), and may
    have its normalized form as ``query_name``, which is dropped. Adds structs
    ``_c`` (resolved name) and ``_m`` (threatened list), and columns
    ``_invasive``, ``_flag``. Join it to the records once instead of joining
    each answer to the records.
    """
    parsed = F.col("query_name") if "query_name" in weights.columns else normalize_name(name_col)
    out = weights.withColumn("_q", parsed).drop("query_name")
    c = cascade.select(F.col("query_name").alias("_q"), F.struct(*cascade.columns).alias("_c"))
    out = out.join(c, "_q", "left")
    if threatened is not None:
        m = threatened.select(F.col("query_name").alias("_q"), F.struct("statusMMA", "statusSourceMMA").alias("_m"))
        out = out.join(m, "_q", "left")
    if invasive is not None:
        i = invasive.select(F.col("query_name").alias("_q"), F.col("invasiveSource").alias("_invasive"))
        out = out.join(i, "_q", "left")
    if flags is not None:
        f = flags.select(F.col("query_name").alias("_q"), "area", F.col("distributionFlag").alias("_flag"))
        out = out.join(f, ["_q", "area"], "left")
    return out.drop("_q")


def standardize(records: DataFrame, answers: DataFrame, keys: list[str], model_columns: list[str] | None = None,
                hot: DataFrame | None = None, replaced=REPLACED_SOURCES, name_col: str = "scientificName",
                keep: tuple[str, ...] = ()) -> DataFrame:
    """Records with standardized columns, in model order, one row per record.

    ``answers`` is a written ``answers_for`` table, unique on ``keys``. Records
    that arrive validated keep their taxonomy; the threatened list, the
    invasive list and the flag go to every record. Where ``answers`` carries
    ``_view_new`` and ``_view_typed`` (``results.view_answers``), the one that
    fits the row comes along as ``_view``.
    """
    model = list(model_columns or records.columns)
    has = {c: c in answers.columns for c in ("_c", "_m", "_invasive", "_flag", "_view_new", "_view_typed")}
    used = [c for c, there in has.items() if there]
    wide = lookup_join(records, answers.select(*keys, *[k for k in keep if k not in keys and k not in records.columns], *used), keys, hot=hot)
    for name in [c for c in [*model, name_col] if c not in wide.columns]:
        wide = wide.withColumn(name, F.lit(None).cast("string"))

    fields = answers.schema["_c"].dataType.fieldNames()
    fill = ~is_prefilled(records.columns) & F.col("_c.query_name").isNotNull()
    new = {}
    for c in model:
        if c in NAME_COLUMNS and c in fields:
            new[c] = F.when(fill, F.col(f"_c.`{c}`")).otherwise(F.col(c))
        elif c in FILL_COLUMNS and c in fields:
            new[c] = F.when(fill, filled_or(F.col(f"_c.`{c}`"), c)).otherwise(F.col(c))
        elif c == "statusIUCN" and "iucnCategory" in fields:
            new[c] = F.when(fill, filled_or("_c.iucnCategory", c)).otherwise(F.col(c))
        elif c == "criteria" and "iucnCriteria" in fields:
            new[c] = F.when(fill, filled_or("_c.iucnCriteria", c)).otherwise(F.col(c))
    if "scientificNameAuthorship" in new:
        typed = typed_authorship(F.col(name_col), F.col("_c.scientificName"))
        new["scientificNameAuthorship"] = F.when(
            fill, filled_or(new["scientificNameAuthorship"], typed)
        ).otherwise(F.col("scientificNameAuthorship"))

    def answer(field: str):
        own = F.col(f"_c.{field}") if field in fields else F.lit(None)
        rest = F.col(f"_m.{field}") if has["_m"] else F.lit(None)
        return F.when(fill, own).otherwise(rest).cast("string")

    # A row no answer applies to keeps its status columns untouched.
    answered = (fill & F.lit("statusMMA" in fields)) | (~fill & F.lit(has["_m"]))
    out = wide.select(
        *[new.get(c, F.col(c)).alias(c) for c in model], *[k for k in keep if k not in model],
        answer("statusMMA").alias("_cat"), answer("statusSourceMMA").alias("_src"), answered.alias("_answered"),
        *[F.col(c) for c in ("_invasive", "_flag") if has[c]],
        *([F.when(fill, F.col("_view_new")).otherwise(F.col("_view_typed")).alias("_view")] if has["_view_new"] else []),
    )
    out = apply_threatened_status(out, "_cat", "_src", replaced, where="_answered")
    # A flag typed in the sheet belongs to another run and never survives.
    flag = F.col("_flag") if has["_flag"] else F.lit(None).cast("string")
    columns = [flag.alias(c) if c == "distributionFlag" else F.col(c) for c in model]
    if "distributionFlag" not in model:
        columns.append(flag.alias("distributionFlag"))
    if has["_invasive"]:
        columns = [c for c, n in zip(columns, [*model, "distributionFlag"]) if n not in ("invasive", "invasiveSource")]
        columns += [
            F.when(F.col("_invasive").isNotNull(), True).alias("invasive"),
            F.col("_invasive").alias("invasiveSource"),
        ]
    return out.select(*columns, *[k for k in keep if k not in model], *(["_view"] if has["_view_new"] else []))


def _attach_by_name(records: DataFrame, table: DataFrame, keys: list[str], name_col: str, hot: DataFrame | None) -> DataFrame:
    """Join ``table`` on the normalized name ``_q`` and the other ``keys``.

    Names are parsed once each: the records are reduced to their distinct keys
    first, and the answers go back on the typed name.
    """
    raw = [name_col, *[k for k in keys if k != "_q"]]
    weights = records.groupBy(*raw).agg(F.count(F.lit(1)).alias("_w"))
    answers = write_stage(weights.withColumn("_q", normalize_name(name_col)).join(table, keys, "left").drop("_q"))
    return lookup_join(records, answers.drop("_w"), raw, hot=hot if hot is not None else hot_keys(answers, raw, weight="_w"))


def attach_flags(records: DataFrame, flags: DataFrame, hot: DataFrame | None = None,
                 name_col: str = "scientificName") -> DataFrame:
    """``distributionFlag`` per record by (area, name); a typed flag is dropped.

    Without an ``area`` column on both sides the name alone is the key.
    """
    by_area = "area" in records.columns and "area" in flags.columns
    keys = [*(["area"] if by_area else []), "_q"]
    table = flags.select(F.col("query_name").alias("_q"), *(["area"] if by_area else []), "distributionFlag")
    return _attach_by_name(records.drop("distributionFlag"), table, keys, name_col, hot)


def attach_invasive(records: DataFrame, hits: DataFrame, hot: DataFrame | None = None,
                    name_col: str = "scientificName") -> DataFrame:
    """``invasive`` (true or null) and ``invasiveSource`` on every record."""
    table = hits.select(F.col("query_name").alias("_q"), F.lit(True).alias("invasive"), "invasiveSource")
    return _attach_by_name(records.drop("invasive", "invasiveSource"), table, ["_q"], name_col, hot)


def localities(records: DataFrame, column: str = "locality") -> DataFrame:
    """The localities of a sheet, trimmed, each once, in order; the areas are linked to them."""
    place = trimmed(column)
    return records.where(is_filled(column)).select(place.alias(column)).distinct().orderBy(column)


def input_inventory(records: DataFrame, name_col: str = "scientificName", locality_col: str = "locality") -> DataFrame:
    """One row: ``records``, ``new_names`` to resolve and ``localities``.

    Records are reduced to distinct (name, locality) pairs, so names are parsed
    once a pair at most and no record is held for a distinct count.
    """
    has = [c for c in (name_col, locality_col) if c in records.columns]
    fresh = F.max(~is_prefilled(records.columns)).alias("_fresh")
    pairs = write_stage(records.groupBy(*has).agg(F.count(F.lit(1)).alias("_n"), fresh))
    names = pairs.where("_fresh").select(name_col).distinct().select(normalize_name(name_col).alias("_q"))
    counts = pairs.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("records"))
    counts = counts.withColumn("new_names", names.agg(F.count_distinct("_q")).scalar())
    places = localities(pairs, locality_col).agg(F.count(F.lit(1))).scalar() if locality_col in has else F.lit(0).cast("long")
    return counts.withColumn("localities", places)
