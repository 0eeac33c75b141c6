"""Row choice per key, and joins whose left side may have hot keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows of one key that one task should hold at most; a key with more is hot.
TASK_ROWS = 2_000_000
# Never more hot keys than this: past it the limit of rows grows. That bound is
# what allows broadcasting the list of hot keys.
HOT_KEYS = 50_000
# Rows (or weight units) and bytes up to which a written lookup table is
# broadcast; measured, not assumed.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 << 20


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], columns: list[str] | None = None) -> DataFrame:
    """The first row of each key in the given order.

    An aggregate with partial results on the map side: a hot key shrinks to one
    row per task before the shuffle, and no group is ever gathered or sorted.
    """
    columns = columns or [c for c in df.columns if c not in keys]
    packed = df.select(
        *keys,
        F.struct(*[F.col(c) for c in columns]).alias("_row"),
        F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)]).alias("_order"),
    )
    return packed.groupBy(*keys).agg(F.min_by("_row", "_order").alias("_row")).select(*keys, "_row.*")


def hot_keys(df: DataFrame, keys: list[str], weight: str | None = None, rows: int | None = None) -> DataFrame:
    """Keys with more rows than a task should hold, and ``_splits``, the tasks they need.

    ``weight`` names a column with the number of rows a row stands for. The
    limit is ``rows``, or the share of the whole that keeps the list within
    ``HOT_KEYS``, whichever is more.
    """
    rows = TASK_ROWS if rows is None else rows
    measure = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.groupBy(*keys).agg(measure.alias("_n"))
    # The total comes from the same counts, so their shuffle can be reused.
    whole = counts.agg(F.sum("_n").alias("_all"))
    limit = F.greatest(F.lit(float(rows)), whole.scalar() / HOT_KEYS)
    return counts.where(F.col("_n") > limit).select(*keys, F.ceil(F.col("_n") / limit).cast("int").alias("_splits"))


def both_hot(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Hot keys of two sides, with the splits of each."""
    marks = left.select(*keys, F.col("_splits").alias("_a"), F.lit(1).alias("_b")).unionByName(
        right.select(*keys, F.lit(1).alias("_a"), F.col("_splits").alias("_b"))
    )
    return marks.groupBy(*keys).agg(F.max("_a").alias("_splits"), F.max("_b").alias("_right_splits"))


def _meet(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], nulls: bool = True) -> Column:
    same = (lambda a, b: a.eqNullSafe(b)) if nulls else (lambda a, b: a == b)
    return reduce(lambda a, b: a & b, [same(left[a], right[b]) for a, b in pairs])


def _numbered(df: DataFrame, marks: DataFrame, pairs: list[tuple[str, str]], own: str, other: str,
              own_name: str, other_name: str) -> DataFrame:
    """Give rows of hot keys one of ``own`` numbers, and repeat them ``other`` times."""
    # The number comes from the row itself: a task that runs again, or gets its
    # rows in another order, gives each row the same one.
    placed = df.withColumn("_dice", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    placed = placed.join(marks, _meet(placed, marks, pairs), "left").select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.coalesce(F.pmod("_dice", own), F.lit(0)).cast("int").alias(own_name),
        F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1).alias("_all"),
    )
    return placed.withColumn(other_name, F.explode("_all")).drop("_all")


def split_join(
    left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame,
    how: str = "left", residual=None, nulls: bool = True,
) -> DataFrame:
    """Equi join with the rows of hot keys split up as their counts ask.

    Left rows of a hot key get one of ``_splits`` numbers and the right rows of
    that key are repeated once per number; where ``hot`` has ``_right_splits``
    (``both_hot``) the right rows are numbered too, for inner joins whose both
    sides are large on one key. The join runs on key and numbers, so each pair
    of rows still meets exactly once. All other keys keep number 0 and nothing
    of them is repeated. ``nulls``: whether null keys meet each other.
    """
    two = "_right_splits" in hot.columns
    if two and how != "inner":
        raise ValueError("splitting both sides needs an inner join")
    # At most HOT_KEYS rows, by hot_keys.
    marks = F.broadcast(hot.select(
        *[F.col(k).alias(f"_h_{k}") for k in keys], "_splits", F.col("_right_splits") if two else F.lit(1).alias("_right_splits"),
    ))
    l = _numbered(left, marks, [(k, f"_h_{k}") for k in keys], "_splits", "_right_splits", "_part", "_part2")
    r = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(f"`{k}`") for k in right.columns])
    r = _numbered(r, marks, [(f"_r_{k}", f"_h_{k}") for k in keys], "_right_splits", "_splits", "_r_part2", "_r_part")
    on = _meet(l, r, [(k, f"_r_{k}") for k in keys], nulls) & (l["_part"] == r["_r_part"]) & (l["_part2"] == r["_r_part2"])
    if residual is not None:
        on = on & residual
    kept = [c for c in r.columns if not c.startswith("_r_")]
    if how in ("left_semi", "left_anti"):
        return l.join(r, on, how).select(*left.columns)
    return l.join(r, on, how).select(*left.columns, *kept)


def fits_broadcast(df: DataFrame, rows: int | None = None, weight: Column | None = None, most_bytes: int | None = None) -> bool:
    """Whether a (written) table has at most ``rows`` rows, or units of ``weight``, and ``most_bytes`` bytes as text."""
    rows = BROADCAST_ROWS if rows is None else rows
    most_bytes = BROADCAST_BYTES if most_bytes is None else most_bytes
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    # Rows past the limit are not weighed.
    n, units, total = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(weight) if weight is not None else F.lit(0), size).first()
    return n <= rows and (units or 0) <= rows and (total or 0) <= most_bytes


def lookup_join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "left",
    hot: DataFrame | None = None, rows: int | None = None, weight: Column | None = None, nulls: bool = True,
) -> DataFrame:
    """Join a large left side to a written lookup table.

    A lookup table that was measured small is broadcast, and the left side is
    not shuffled at all; a larger one meets the left side in ``split_join``.
    ``weight`` measures rows of uneven size, such as rows with arrays.
    """
    if fits_broadcast(right, rows, weight):
        r = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(f"`{k}`") for k in right.columns])
        joined = left.join(F.broadcast(r), _meet(left, r, [(k, f"_r_{k}") for k in keys], nulls), how)
        if how in ("left_semi", "left_anti"):
            return joined
        return joined.select(*left.columns, *[c for c in right.columns if c not in keys])
    return split_join(left, right, keys, hot if hot is not None else hot_keys(left, keys), how, nulls=nulls)
