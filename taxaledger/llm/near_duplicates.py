"""Near-duplicate classes of documents: BagMinHash, bands, exact verification.

1. One pass makes each text's signature of ``BANDS * ROWS`` components over its
   bag of five-word shingles, and one hash per band. Texts of equal digest are
   one node, with map-side aggregation, so copies never meet as pairs.
2. Nodes of an equal band hash share a bucket. A pair of similarity 0.8 shares
   none of the 25 buckets with a probability of 5 in 100,000. A bucket is led by
   its smallest node, and buckets of one leader are one ball: nearly all buckets
   of a group of near copies are, so a pair is not met 25 times.
3. Two rounds, whatever the data. First each node meets its smallest leader, and
   links make components. Most balls lie within one component then and are done.
   In each other ball the members are dealt into blocks of about
   ``BLOCK`` shingles, and pairs of blocks (cells) are compared, each in a task of its own size;
   blocks of the ball's largest component do not meet each other. A cell sends
   back a forest of the components that its links join, not its pairs. So every
   pair of a bucket is either compared or already in one class: no link is lost,
   however large the bucket. The work of a ball whose members stay unlike grows
   with their pairs of blocks, spread over the tasks.
4. A comparison is exact: sum of minima over sum of maxima of the shingle counts
   (weighted Jaccard), from the shingles of the nodes in buckets, read in a
   second pass whose rows are thinned by a bit array of fixed size.

A very long text is hashed whole in one task, some 50 bytes a byte of it.
Defined results: a null text counts as the empty text; texts without words are
only in a class with equal texts; a text of fewer than five words is one
shingle; class_id is the smallest doc_id of the class (null if all are null);
``kept`` is true for one row of each class, that of the smallest doc_id, nulls
last; rows of equal doc_id are separate; an empty table gives none; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaledger.llm.bag_minhash import bands, shingles, signatures
from taxaledger.llm.components import components
from taxaledger.llm.key_bits import collect_bits, may_hold, unpacked
from taxaledger.llm.overlap_blocks import links, unary
from taxaledger.llm.texts import release, slices
from taxaledger.llm.word_hashes import Words
from taxaledger.session import write_stage

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 25, 5
#: Shingles of a block: what a cell holds is at most two blocks, 8 bytes a shingle.
BLOCK = 1 << 18
#: A node counts as this many shingles at least, so that a block has at most some 1,000 nodes.
LEAST = 256
#: Nodes of a bucket that are held in one row.
CHUNK = 4096


def _keyed(docs: DataFrame, id_col: str, text_col: str, row_col: str | None = None) -> DataFrame:
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), row.alias("rid"))
    return own.withColumns({"digest": F.unhex(F.md5("text")), "short_key": F.xxhash64("text")})


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, row_col: str | None = None) -> DataFrame:
    """(rid, doc_id, digest, short_key, bands) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words([t.encode() for t in batch.column("text").to_pylist()])
            doc, h, count = shingles(words, k)
            got = bands(signatures(doc, h, count, batch.num_rows, BANDS * ROWS), BANDS)
            n = np.where(words.counts() > 0, BANDS, 0)
            values = pa.array(got[n > 0].reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("rid", "doc_id", "digest", "short_key")], lists], ["rid", "doc_id", "digest", "short_key", "bands"])

    rows = _keyed(docs, id_col, text_col, row_col)
    return rows.select("rid", "doc_id", "digest", "short_key", "text").mapInArrow(run, "rid long, doc_id long, digest binary, short_key long, bands array<long>")


def bags(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(node, bag, size) of the texts of ``wanted`` (node, digest, short_key); see ``overlap_blocks``."""
    held = docs.sparkSession.sparkContext.broadcast(collect_bits(wanted.select("short_key")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, done = unpacked(held.value), set()
        for batch in slices(batches):
            batch = batch.filter(pa.array(may_hold(seen, batch.column("short_key").to_numpy())))
            new = {d: i for i, d in enumerate(batch.column("digest").to_pylist()) if d not in done}
            done.update(new)
            doc, h = unary(*shingles(Words([batch.column("text")[i].as_py().encode() for i in new.values()]), k))
            at = np.searchsorted(doc, np.arange(len(new) + 1))
            made = [h[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.binary()), pa.array(made, pa.binary())], ["digest", "bag"])

    rows = _keyed(docs, id_col, text_col).select("digest", "short_key", "text").mapInArrow(run, "digest binary, bag binary")
    # One bag a text and task leaves the first step, one a text the second.
    once = rows.groupBy("digest").agg(F.first("bag").alias("bag"))
    return once.join(wanted.select("node", "digest"), "digest").select("node", "bag", (F.length("bag") / 8).cast("long").alias("size"))


def balls(nodes: DataFrame, n_nodes: int) -> DataFrame:
    """(node, leads): of each node that shares buckets, the smallest nodes of these."""
    salt = F.pmod(F.xxhash64("node"), F.lit(1 + n_nodes // CHUNK))
    entries = nodes.select("node", F.explode("bands").alias("bucket"), salt.alias("salt"))
    chunks = write_stage(entries.groupBy("bucket", "salt").agg(F.collect_list("node").alias("nodes")))
    leads = chunks.groupBy("bucket").agg(F.min(F.array_min("nodes")).alias("lead"), F.sum(F.size("nodes")).alias("n")).filter("n > 1")
    members = chunks.join(leads.select("bucket", "lead"), "bucket").select("lead", F.explode("nodes").alias("node"))
    return members.groupBy("node").agg(F.collect_set("lead").alias("leads"))


def _blocks(weight: Column) -> Column:
    return F.ceil(weight / BLOCK).cast("long")


def compared(cells: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links of components, from the rows (lead, i, j, side, comp, bag) of each cell.

    Bags of side 0 meet those of side 1; in a cell without side 0 all meet all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            a, b = links(held, np.array(comps, np.int64), left, threshold)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        release()
        cell, left, held, comps = None, 0, [], []
        for batch in batches:
            keys = zip(*[batch.column(c).to_pylist() for c in ("lead", "i", "j")], strict=True)
            for key, side, comp, bag in zip(keys, batch.column("side").to_pylist(), batch.column("comp").to_pylist(), batch.column("bag"), strict=True):
                if key != cell:
                    if held:
                        yield done()
                    cell, left, held, comps = key, 0, [], []
                left += side == 0
                held.append(np.frombuffer(bag.as_py(), np.uint64))
                comps.append(comp)
        if held:
            yield done()

    by = ["lead", "i", "j"]
    rows = cells.select(*by, "side", "comp", "bag").repartition(*by).sortWithinPartitions(*by, "side")
    return rows.mapInArrow(run, "a long, b long")


def _joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """``comps`` (node, comp) after the links (a, b) of components."""
    merged = components(links).select(F.col("node").alias("comp"), F.col("comp").alias("root"))
    return write_stage(comps.join(merged, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")))


def _stars(near: DataFrame, held: DataFrame) -> DataFrame:
    """Cells of each smallest leader with a part of the nodes that it leads."""
    star = near.select("node", F.array_min("leads").alias("lead")).filter("node <> lead").join(held, "node")
    parts = star.groupBy("lead").agg(_blocks(F.sum(F.greatest("size", F.lit(LEAST)))).alias("parts"))
    members = star.join(parts, "lead").select(
        "lead", F.pmod(F.xxhash64("node"), F.col("parts")).alias("i"), F.lit(0).alias("j"), F.lit(1).alias("side"), F.col("node").alias("comp"), "bag"
    )
    leaders = parts.join(held.select(F.col("node").alias("lead"), "bag"), "lead").select(
        "lead", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), F.col("lead").alias("comp"), "bag"
    )
    # A part may have no member; its leader is then alone in the cell.
    return leaders.union(members)


def _cells(near: DataFrame, comps: DataFrame, held: DataFrame) -> DataFrame:
    """Cells of the balls that lie in several components."""
    placed = write_stage(near.join(comps, "node").join(held.select("node", F.greatest("size", F.lit(LEAST)).alias("weight")), "node"))
    star = (F.col("lead") == F.col("node")) | (F.col("lead") == F.array_min("leads"))
    flat = placed.select("node", "comp", "weight", "leads", F.explode("leads").alias("lead")).withColumn("met", star)
    groups = flat.groupBy("lead", "comp").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"), F.min("met").alias("met"))
    ball = groups.groupBy("lead").agg(F.count("*").alias("comps"), F.sum("n").alias("n"), F.min("met").alias("met"), F.sum("weight").alias("all"), F.max(F.struct("weight", "comp")).alias("most"))
    # Two nodes of which one leads the other have met.
    ball = ball.filter((F.col("comps") > 1) & ~((F.col("n") == 2) & F.col("met")))
    small = F.col("all") <= BLOCK
    ball = write_stage(ball.select(
        "lead", F.when(~small, F.col("most.comp")).alias("largest"),
        F.when(small, 1).otherwise(_blocks(F.col("all") - F.col("most.weight"))).cast("long").alias("others"), F.when(small, 0).otherwise(_blocks(F.col("most.weight"))).cast("long").alias("inside"),
    ))
    inside = F.col("largest").eqNullSafe(F.col("comp"))
    block = F.pmod(F.xxhash64("node"), F.when(inside, F.col("inside")).otherwise(F.col("others")))
    cell = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), side.alias("side"))
    up_to = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    own = F.transform(up_to(F.col("others")), lambda i: cell(i, F.col("others") + F.col("block"), F.lit(1)))
    met = F.transform(
        up_to(F.col("others") + F.col("inside")),
        lambda j: cell(F.least("block", j), F.greatest(F.col("block"), j), F.when(F.col("block") < j, 0).otherwise(1)),
    )
    rows = flat.select("lead", "node", "comp").join(ball, "lead").withColumn("block", block)
    rows = rows.select("lead", "node", "comp", F.when(inside, own).otherwise(met).alias("cells")).join(held.select("node", "bag"), "node")
    return rows.select("lead", "comp", "bag", F.explode("cells").alias("c")).select("lead", "c.i", "c.j", "c.side", "comp", "bag")


def classes_of(near: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """(node, comp) of the nodes of ``near`` (node, leads)."""
    comps = _joined(near.select("node", F.col("node").alias("comp")), write_stage(compared(_stars(near, held), threshold)))
    return _joined(comps, write_stage(compared(_cells(near, comps, held), threshold)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, threshold: float = SIMILAR, row_col: str | None = None) -> DataFrame:
    """(doc_id, class_id, class_size, kept, rid) of every row; ``row_col`` holds a unique number of the row, if there is one."""
    rows = write_stage(sketches(docs, id_col, text_col, k, row_col))
    nodes = write_stage(rows.groupBy("digest").agg(F.min("rid").alias("node"), F.first("short_key").alias("short_key"), F.first("bands").alias("bands")))
    near = write_stage(balls(nodes, nodes.count()))
    wanted = write_stage(nodes.join(near.select("node"), "node").select("node", "digest", "short_key"))
    held = write_stage(bags(docs, wanted, id_col, text_col, k))
    comps = classes_of(near, held, threshold)

    named = nodes.select("digest", "node").join(comps, "node", "left").select("digest", F.coalesce("comp", "node").alias("comp"))
    placed = rows.select("rid", "doc_id", "digest").join(write_stage(named), "digest")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid"))
    classes = write_stage(placed.groupBy("comp").agg(first.alias("first"), F.count("*").alias("class_size")))
    return placed.join(classes, "comp").select("doc_id", F.col("first.doc_id").alias("class_id"), "class_size", (F.col("first.rid") == F.col("rid")).alias("kept"), "rid")
