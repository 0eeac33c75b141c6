"""Names within an edit-distance budget, without comparing all pairs.

A name of length L may differ from its match by ``ceil(0.1 * L)`` edits. Short
names, which may differ by one or two, meet on what is left of them after as
many deletions (``remnants``): two names within d edits have a text in common
that either becomes by at most d deletions. A remnant holds nearly the whole
name, so names that share a genus do not meet for that alone. Two deletions of
a longer name leave many remnants, most of them of a beginning that many names
share, so such names are cut in two: beginnings are compared once each, and
names meet on a beginning and what is left of the end (``_tail_signatures``).
Ends that are left alike are within the edits only if the deletions lie at places
that fit; that is one comparison of bits, before any distance is worked out.

Longer names would leave too many remnants. A target cut into one more segment
than edits allowed keeps at least one segment intact (pigeonhole; Li, Deng, Wang
and Feng, "Pass-Join", VLDB 2011), so they meet in an equi join on (budget,
target length, segment number, segment text). The window of start positions per
segment is the multi-match-aware one of that paper. All filters lose nothing, so
the answer equals the all-pairs one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_stage
from .joins import both_hot, hot_keys, lookup_join, split_join

_LETTERS = "abcdefghijklmnopqrstuvwxyz"


# Rows of one signature that one task should hold on a side; each meets each.
SIGNATURE_ROWS = 50_000
# Names meet on remnants up to this budget and length: a name of n characters
# leaves about n ** budget / budget of them.
REMNANT_EDITS = 2
REMNANT_LENGTH = 32
# Targets up to this length meet on remnants of the whole name, longer ones on
# those of their last TAIL characters where two edits are searched.
WHOLE_LENGTH = 12
TAIL = 6
# Bits of the places deleted from a tail: one per pair of places, one per place
# twice over, and one that every target has.
_BESIDE, _SAME, _ANY = TAIL * TAIL, TAIL * TAIL + TAIL, TAIL * TAIL + 2 * TAIL


def edit_budget(name: Column, max_distance: float = 0.1) -> Column:
    return F.ceil(F.round(F.length(name) * F.lit(max_distance), 9)).cast("int")


def letters_present(name: str) -> Column:
    """Two bits per letter of the alphabet: it occurs, it occurs again.

    One edit takes one letter away, brings one, or both, so it changes at most
    two bits.
    """
    low = f"lower(`{name}`)"
    count = f"least(2, length({low}) - length(replace({low}, '{{letter}}', '')))"
    terms = [
        f"CASE {count.format(letter=x)} WHEN 1 THEN {1 << 2 * i}L WHEN 2 THEN {3 << 2 * i}L ELSE 0L END"
        for i, x in enumerate(_LETTERS)
    ]
    return F.expr(" + ".join(terms))


def pairs_present(name: Column) -> Column:
    """64 bits of the letter pairs of a name; one edit changes at most four.

    A replaced letter takes two pairs away and brings two; two pairs on one bit
    only make the difference smaller, so the test stays on the safe side.
    """
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(name) - 1))
    return F.aggregate(
        places, F.lit(0).cast("long"),
        lambda mask, i: mask.bitwiseOR(F.call_function(
            "shiftleft", F.lit(1).cast("long"), F.pmod(F.hash(F.substr(name, i, F.lit(2))), F.lit(64)))),
    )


def _segment_start(number: Column, length: Column, budget: Column) -> Column:
    """Zero-based start of segment ``number`` (1-based) of an even cut."""
    short = F.floor(length / (budget + 1)).cast("int")
    longer = length % (budget + 1)
    before = number - 1
    return before * short + F.greatest(F.lit(0), before - (budget + 1 - longer))


def _segment_length(number: Column, length: Column, budget: Column) -> Column:
    short = F.floor(length / (budget + 1)).cast("int")
    return short + F.when(number > budget + 1 - length % (budget + 1), 1).otherwise(0)


def _signature(budget, length, number, text) -> Column:
    return F.xxhash64(budget, length, number, text)


def target_index(targets: DataFrame, name: str, max_distance: float = 0.1) -> DataFrame:
    """Targets exploded to one row per (possible budget, segment).

    A target of length n can only meet budgets t with some length L,
    ``t = ceil(d * L)`` and ``|L - n| <= t``; that is one or two values of t, so
    a name gives a handful of rows whatever its length.
    """
    n = F.length(F.col(name))
    d = F.lit(max_distance)
    low = F.ceil(n * d / (1 + d) - F.lit(1e-9)).cast("int")
    high = F.floor((n * d + 1) / F.greatest(F.lit(1e-9), 1 - d) + F.lit(1e-9)).cast("int")
    df = targets.select("*", n.alias("_n"), letters_present(name).alias("_target_letters"),
                        pairs_present(F.col(name)).alias("_target_pairs"))
    df = df.withColumn("_t", F.explode(F.sequence(F.greatest(F.lit(0), low), F.greatest(F.lit(0), low, high))))
    df = df.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_t") + 1)))
    start = _segment_start(F.col("_i"), F.col("_n"), F.col("_t"))
    size = _segment_length(F.col("_i"), F.col("_n"), F.col("_t"))
    text = F.substr(F.col(name), start + 1, size)
    head = F.substr(F.col(name), F.lit(1), _segment_length(F.lit(1), F.col("_n"), F.col("_t")))
    return df.withColumn("_target_head", F.xxhash64(head)).withColumn(
        "_sig", _signature(F.col("_t"), F.col("_n"), F.col("_i"), text)
    ).drop("_t", "_n", "_i")


def query_signatures(queries: DataFrame, name: str, max_distance: float = 0.1, lengths: DataFrame | None = None) -> DataFrame:
    """Every substring of a query that can equal a segment of some target.

    ``lengths`` (``_n``) holds the lengths that targets have. Others have no
    match, so nothing is made for them: a page of text in a name cell costs what
    the targets of about its length ask for, which is mostly nothing.
    """
    df = queries.select(
        "*",
        F.length(F.col(name)).alias("_l"),
        edit_budget(F.col(name), max_distance).alias("_t"),
        letters_present(name).alias("_letters"),
        pairs_present(F.col(name)).alias("_pairs"),
    )
    t, length = F.col("_t"), F.col("_l")
    df = df.withColumn(
        "_n", F.explode(F.sequence(F.greatest(F.lit(1), length - t), length + t))
    )
    if lengths is not None:
        df = df.join(lengths, "_n", "left_semi")
    df = df.withColumn("_i", F.explode(F.sequence(F.lit(1), t + 1)))
    n, i = F.col("_n"), F.col("_i")
    df = df.withColumn("_start", _segment_start(i, n, t)).withColumn(
        "_size", _segment_length(i, n, t)
    )
    shift = length - n
    first = F.greatest(F.lit(0), F.col("_start") - (i - 1), F.col("_start") + shift - (t + 1 - i))
    last = F.least(
        length - F.col("_size"), F.col("_start") + (i - 1), F.col("_start") + shift + (t + 1 - i)
    )
    df = df.withColumn("_first", first).withColumn("_last", last).where("_first <= _last")
    df = df.withColumn("_p", F.explode(F.sequence("_first", "_last")))
    text = F.substr(F.col(name), F.col("_p") + 1, F.col("_size"))
    head = F.substr(F.col(name), F.lit(1), _segment_length(F.lit(1), n, t))
    df = df.withColumn("_head", F.when(i > 1, F.xxhash64(head))).withColumn("_sig", _signature(t, n, i, text))
    return df.drop("_l", "_n", "_i", "_start", "_size", "_first", "_last", "_p").distinct()


def is_short(name: Column, max_distance: float = 0.1) -> Column:
    """Whether a query meets its targets on remnants."""
    return (edit_budget(name, max_distance) <= REMNANT_EDITS) & (F.length(name) <= REMNANT_LENGTH)


def _bit(place: Column | int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place if isinstance(place, Column) else F.lit(place))


def remnants(df: DataFrame, name: str, edits: int, head: str | None = None,
             asks: Callable[[Column], Column] | None = None,
             places: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """One row per text left by at most ``edits`` (1 or 2) deletions, as ``_sig``.

    ``head`` names a column that goes into the signature. ``asks`` tells from the
    number of deletions whether a row wants it, where it does not want all.
    ``places`` makes a column ``_places`` of that number and the two places.
    """
    n, i, j = F.length(name), F.col("_i"), F.col("_j")
    text = F.col(name)
    # Place n + 1 stands for no deletion.
    df = df.withColumn("_i", F.explode(F.sequence(F.lit(1), n + 1)))
    start = F.substr(text, F.lit(1), i - 1)
    if edits == 1:
        left = F.concat(start, F.substr(text, i + 1))
        made = (i <= n).cast("int")
    else:
        df = df.withColumn("_j", F.explode(F.sequence(F.least(i + 1, n + 1), n + 1)))
        left = F.concat(start, F.substr(text, i + 1, F.greatest(F.lit(0), j - i - 1)), F.substr(text, j + 1))
        made = (i <= n).cast("int") + (j <= n).cast("int")
    if asks is not None:
        df = df.where(asks(made))
    if places is not None:
        df = df.withColumn("_places", places(made, i, j))
    return df.withColumn("_sig", F.xxhash64(*([F.col(head)] if head else []), left)).drop("_i", "_j")


def near_heads(cuts: DataFrame, heads: DataFrame, edits: int) -> DataFrame:
    """``_start, _head, _off``: the beginnings of queries and of targets within ``edits``, each pair once."""
    wanted = remnants(cuts.select("_start").distinct(), "_start", edits)
    index = remnants(heads.select("_head").distinct(), "_head", edits).withColumnRenamed("_sig", "_head_sig")
    met = (F.col("_sig") == F.col("_head_sig")) & (F.call_function("levenshtein", F.col("_start"), F.col("_head"), F.lit(edits)) >= 0)
    pairs = wanted.join(index, met).select("_start", "_head").distinct()
    return pairs.withColumn("_off", F.levenshtein("_start", "_head"))


def _tail_signatures(queries: DataFrame, targets: DataFrame, query: str, target: str, edits: int) -> tuple[DataFrame, DataFrame]:
    """``_sig, _places`` rows of queries and of targets, from the ends of names.

    A target is a head and a tail of ``TAIL`` characters. Where a query is within
    d edits of it, the query can be cut so that both parts together are. The
    query's beginnings of fitting length are held against the heads; with e
    edits there, d - e are left for the tails, of which the longer one then
    loses d - e characters. Of a query that starts with the head, the rest is as
    far from the tail as the whole names are, so no other cut is tried.

    Tails left alike are d - e edits apart if ``_places`` have a bit in common:
    replaced characters lie at the same place of both tails (of tails that
    differ by one in length, perhaps one further on in the longer). Tails of one
    length may also lose one character each, anywhere: one edit brings it, one
    takes it away.
    """
    n = F.length(target)
    index = targets.withColumn("_head", F.substr(F.col(target), F.lit(1), n - TAIL)).withColumn(
        "_tail", F.substr(F.col(target), n - TAIL + 1))
    length, at = F.length(query), F.col("_at")
    around = F.sequence(F.greatest(F.lit(0), length - TAIL - edits), length - TAIL + edits)
    cuts = queries.withColumn("_at", F.explode(around)).withColumn("_start", F.substr(F.col(query), F.lit(1), at)).withColumn(
        "_tail", F.substr(F.col(query), at + 1))
    left, longer = edits - F.col("_off"), F.length("_tail") - TAIL
    # Many names share a beginning: a short list goes to them, else the frequent ones are split.
    cuts = lookup_join(cuts, write_stage(near_heads(cuts, index, edits)), ["_start"], "inner").where(
        (F.abs(longer) <= left) & ((F.col("_off") == 0) | ~F.startswith(F.col(query), F.col("_head"))))

    def asks(made: Column) -> Column:
        # A shorter tail loses that many fewer.
        return (made == left + F.least(F.lit(0), longer)) | ((left == 2) & (longer == 0) & (made == 1))

    def asked_places(made: Column, i: Column, j: Column) -> Column:
        same, beside = _bit(_SAME + i - 1), _bit(_BESIDE + i - 1)
        two = F.when(longer == 0, F.when(made == 2, _bit((i - 1) * TAIL + j - 1))).when(longer == -1, beside).when(
            longer == 1, same.bitwiseOR(_bit(_SAME + j - 2)))
        return F.coalesce(F.when(left == 2, two).when((left == 1) & (longer == 0), same), _bit(_ANY))

    def held_places(made: Column, i: Column, j: Column) -> Column:
        pair = _bit((i - 1) * TAIL + j - 1).bitwiseOR(_bit(_BESIDE + i - 1)).bitwiseOR(_bit(_BESIDE + j - 2))
        own = F.when(made == 2, pair).when(made == 1, _bit(_SAME + i - 1)).otherwise(F.lit(0).cast("long"))
        return own.bitwiseOR(_bit(_ANY))

    wanted = remnants(cuts, "_tail", edits, "_head", asks, asked_places)
    index = remnants(index, "_tail", edits, "_head", places=held_places)
    return wanted.select(*queries.columns, "_sig", "_places"), index.select(*targets.columns, "_sig", "_places")


def _of_lengths(df: DataFrame, name: str, other: DataFrame, other_name: str, edits: int) -> DataFrame:
    """Rows of ``df`` whose name is at most ``edits`` longer or shorter than some name of ``other``."""
    lengths = other.select(F.length(other_name).alias("_l")).distinct()
    lengths = lengths.select(F.explode(F.sequence(F.col("_l") - edits, F.col("_l") + edits)).alias("_n")).distinct()
    return df.withColumn("_n", F.length(name)).join(lengths, "_n", "left_semi").drop("_n")


def remnant_pairs(
    queries: DataFrame, targets: DataFrame, query: str, target: str, edits: int,
    max_distance: float = 0.1, keep: Column | None = None,
) -> DataFrame:
    """Pairs of short queries and targets within the budget and ``edits``, with their ``distance``.

    Distinct names that share a remnant differ in a letter or two at most on
    either side, which bounds the rows of one signature by the alphabet, not by
    the table. A pair that shares several remnants shows several times.
    """

    def whole(df: DataFrame, name: str) -> DataFrame:
        return remnants(df, name, edits, places=lambda made, i, j: _bit(_ANY))

    short = queries.where(is_short(F.col(query), max_distance))
    asked, held = _of_lengths(short, query, targets, target, edits), _of_lengths(targets, target, short, query, edits)
    if edits == 1:
        wanted, index = whole(asked, query), whole(held, target)
    else:
        long = F.length(target) > WHOLE_LENGTH
        wanted, index = _tail_signatures(asked.where(F.length(query) > WHOLE_LENGTH - edits), held.where(long), query, target, edits)
        wanted = wanted.unionByName(whole(asked.where(F.length(query) <= WHOLE_LENGTH + edits), query))
        index = index.unionByName(whole(held.where(~long), target))
    index = index.withColumnsRenamed({"_sig": "_target_sig", "_places": "_target_places"})
    most = F.least(F.lit(edits), edit_budget(F.col(query), max_distance))
    met = (F.col("_places").bitwiseAND(F.col("_target_places")) != 0) & (
        F.call_function("levenshtein", F.col(query), F.col(target), most) >= 0)
    pairs = wanted.join(index, (F.col("_sig") == F.col("_target_sig")) & (met if keep is None else keep & met))
    return pairs.withColumn("distance", F.call_function("levenshtein", F.col(query), F.col(target), most)).select(
        *queries.columns, *targets.columns, "distance"
    )


def fuzzy_pairs(
    queries: DataFrame, targets: DataFrame, query: str, target: str,
    max_distance: float = 0.1, keep: Column | None = None,
) -> DataFrame:
    """All (query, target) pairs within the budget, with their ``distance``.

    A pair may show several times; the reductions that follow do not mind.
    """
    near = remnant_pairs(queries, targets, query, target, REMNANT_EDITS, max_distance, keep)
    return near.unionByName(segment_pairs(queries.where(~is_short(F.col(query), max_distance)), targets, query, target, max_distance, keep))


def segment_pairs(
    queries: DataFrame, targets: DataFrame, query: str, target: str,
    max_distance: float = 0.1, keep: Column | None = None,
) -> DataFrame:
    """The pairs of queries of any length, met on segments.

    The letter tests and the bounded edit distance are part of the join
    condition: pairs that fail never leave the join. Signatures that many
    targets share (a species-rich genus) are split over tasks. A pair that meets
    on two segments shows twice; the reductions that follow do not mind.
    """
    # Both feed the counts of hot signatures and the join: built once.
    budget = edit_budget(F.col(query), max_distance)
    reach = queries.select(F.length(query).alias("_l"), budget.alias("_t")).distinct()
    reach = reach.select(F.explode(F.sequence(F.col("_l") - F.col("_t"), F.col("_l") + F.col("_t"))).alias("_n")).distinct()
    # Targets that no query can reach by its length are left out, as are queries that reach none.
    targets = targets.withColumn("_n", F.length(target)).join(reach, "_n", "left_semi").drop("_n")
    lengths = write_stage(targets.select(F.length(target).alias("_n")).distinct())
    index = write_stage(target_index(targets, target, max_distance))
    wanted = write_stage(query_signatures(queries, query, max_distance, lengths))
    # A pair that shares its first segment meets there; it is not tested again
    # on the later ones.
    again = F.coalesce(F.col("_head") == F.col("_target_head"), F.lit(False))
    within = (
        ~again
        & (F.bit_count(F.col("_pairs").bitwiseXOR(F.col("_target_pairs"))) <= 4 * F.col("_t"))
        & (F.bit_count(F.col("_letters").bitwiseXOR(F.col("_target_letters"))) <= 2 * F.col("_t"))
        & (F.call_function("levenshtein", F.col(query), F.col(target), F.col("_t")) >= 0)
    )
    if keep is not None:
        within = keep & within
    # A signature can be common among the targets, the queries, or both.
    hot = both_hot(hot_keys(index, ["_sig"], rows=SIGNATURE_ROWS), hot_keys(wanted, ["_sig"], rows=SIGNATURE_ROWS), ["_sig"])
    pairs = split_join(index, wanted, ["_sig"], hot, how="inner", residual=within, nulls=False)
    return pairs.withColumn("distance", F.levenshtein(F.col(query), F.col(target))).select(
        *queries.columns, *targets.columns, "distance"
    )
