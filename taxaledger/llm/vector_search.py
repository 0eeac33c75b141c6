"""Nearest neighbours with one vantage-point tree per shard.

Rows are spread over shards of about ``SHARD_ROWS`` by a hash of their row, so
equal vectors or ids make no large shard. Each shard's tree is built once and
written. Queries are packed in blocks of ``BLOCK_ROWS``; a cell is one tree and
up to ``CELL_BLOCKS`` blocks, and cells are dealt over tasks by shard and blocks.
So a tree is copied once for that many blocks, and no task holds more than a
cell; the cells' results are merged per query. A subtree is skipped
if the triangle inequality puts all of it farther than the query's worst hit
times ``factor``: 1, as set, never loses a neighbour; smaller factors skip more
and lose neighbours, the more the fewer dimensions the vectors really span.

Nearness is the Euclidean distance in double precision; ties go to the smaller
vec_id. Only vectors of a query's length are its candidates.

Defined results: vectors that are null, empty, all zero or hold null or
non-finite components take no part, nor do rows with a null vec_id; rows of
equal vec_id are separate (a query never finds its own row); fewer candidates
than ``k`` give fewer rows; an empty table gives none; other columns are not
read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxaledger.llm.vp_tree import Search, Tree, build
from taxaledger.session import write_stage

SHARD_ROWS = 8192
BLOCK_ROWS = 2048
#: Blocks of queries that meet a tree in one cell.
CELL_BLOCKS = 16
FACTOR = 1.0
K = 10

_TREE = "shard long, dim int, ids binary, rows binary, vectors binary, tree_order binary, nodes binary"
_FOUND = "query_row long, query_id long, vec_id long, score double"


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>, dim) of the rows that take part."""
    v = F.col("v")
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return own.filter(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False))).withColumn("dim", F.size("v"))


def _packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One shard with its tree."""
    rows = rows.sort_values("row")
    x = np.stack(rows["v"].to_numpy()).astype("<f8")
    tree = build(x)
    return pd.DataFrame([{
        "shard": key[0], "dim": key[1], "ids": rows["vec_id"].to_numpy("<i8").tobytes(), "rows": rows["row"].to_numpy("<i8").tobytes(),
        "vectors": x.tobytes(), "tree_order": tree.order.astype("<i8").tobytes(), "nodes": np.array(tree.nodes, "<f8").tobytes(),
    }])


def _block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([{"block": key[0], "dim": key[1], "q_ids": rows["vec_id"].to_numpy("<i8").tobytes(), "q_rows": rows["row"].to_numpy("<i8").tobytes(), "q_vectors": np.stack(rows["v"].to_numpy()).astype("<f8").tobytes()}])


def trees(rows: DataFrame, n_rows: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard and vector length of (row, vec_id, v, dim)."""
    shards = max(1, -(-n_rows // shard_rows))
    return rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards))).groupBy("shard", "dim").applyInPandas(_packed, _TREE)


def nearest(index: DataFrame, queries: DataFrame, n_queries: int, k: int = K, factor: float = FACTOR, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the queries (row, vec_id, v, dim)."""
    blocks = max(1, -(-n_queries // block_rows))
    packed = queries.withColumn("block", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks))).groupBy("block", "dim").applyInPandas(
        _block, "block long, dim int, q_ids binary, q_rows binary, q_vectors binary"
    )
    parts = -(-blocks // CELL_BLOCKS)
    shards = 1 + (index.agg(F.max("shard")).first()[0] or 0)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    def run(trees_: pa.Table, blocks_: pa.Table) -> pa.Table:
        """The nearest of a cell's tree to the queries of its blocks."""
        found = []
        for r in trees_.to_pylist():
            ids, rows, order = (np.frombuffer(r[c], "<i8") for c in ("ids", "rows", "tree_order"))
            x = np.frombuffer(r["vectors"], "<f8").reshape(-1, r["dim"])
            nodes = [(int(a), int(b), int(c), d, int(e), int(f), int(g)) for a, b, c, d, e, f, g in np.frombuffer(r["nodes"], "<f8").reshape(-1, 7).tolist()]
            for b in blocks_.to_pylist():
                q_ids, q_rows = (np.frombuffer(b[c], "<i8") for c in ("q_ids", "q_rows"))
                q = np.frombuffer(b["q_vectors"], "<f8").reshape(-1, r["dim"])
                best, best_id = Search(Tree(order, nodes), x, ids, rows, q, q_rows, k, factor).run()
                at, place = np.nonzero(np.isfinite(best))
                found.append([q_rows[at], q_ids[at], best_id[at, place], best[at, place]])
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0, t) for t in ("i8", "i8", "i8", "f8")]
        return pa.table(columns, names=["query_row", "query_id", "vec_id", "score"])

    # A set number of partitions: cells are small to move and long to search, so they must not be put together by size.
    cell, tasks = ["shard", "dim", "part"], min(1 << 15, 4 * shards * parts)
    left = index.withColumn("part", each(parts)).repartition(tasks, *cell)
    right = packed.withColumn("part", F.floor(F.col("block") / CELL_BLOCKS)).withColumn("shard", each(shards)).repartition(tasks, *cell)
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(run, _FOUND)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = K, factor: float = FACTOR, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The nearest rows of each row whose id is divisible by ``every``."""
    rows = write_stage(usable(vectors, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()))
    queries = rows.filter(F.col("vec_id") % every == 0)
    index = write_stage(trees(rows, rows.count(), shard_rows))
    return nearest(index, queries, queries.count(), k, factor)
