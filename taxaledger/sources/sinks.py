"""Result tables as delimited text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.audit import unresolved
from ..operators.canonical import ensure_columns


def export_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Every cell as text, nulls as empty text, columns in model order."""
    columns = list(columns or df.columns)
    df = ensure_columns(df, columns)
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in columns])


def label_row(df: DataFrame, columns: list[str] | None = None, labels: dict[str, str] | None = None) -> DataFrame:
    """One row: the label of each column, from metadata or ``labels``.

    A placeholder label that a reader made up (``...3``) shows as empty.
    """
    columns = list(columns or df.columns)
    held = {f.name: f.metadata.get("label", "") for f in df.schema.fields} | (labels or {})
    shown = [held.get(c) or "" for c in columns]
    shown = ["" if s.startswith("...") and s[3:].isdigit() else s for s in shown]
    return df.sparkSession.range(1).select(*[F.lit(s).alias(c) for s, c in zip(shown, columns)])


def write_standardized(df: DataFrame, path: str, columns: list[str] | None = None, labels: dict[str, str] | None = None) -> None:
    """Rows with a header under ``path/rows``, the labels under ``path/labels``.

    Files of one folder have no order among them, so the label row cannot be
    the first row of the data.
    """
    export_rows(df, columns).write.csv(f"{path}/rows", header=True, emptyValue="")
    label_row(df, columns, labels).write.csv(f"{path}/labels", header=True, emptyValue="")


def write_audit(audit: DataFrame, path: str, open_rows: DataFrame | None = None) -> None:
    """``auditoria`` (all decisions) and ``nao_resolvidos`` (those left open)."""
    export_rows(audit).write.csv(f"{path}/auditoria", header=True, emptyValue="")
    rest = unresolved(audit) if open_rows is None else open_rows
    export_rows(rest).write.csv(f"{path}/nao_resolvidos", header=True, emptyValue="")
