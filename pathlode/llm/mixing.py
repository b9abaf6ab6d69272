"""Mixing sources to target weights by temperature.

The share of each source in all tokens is raised to an exponent and normalised. The exponent, between 0
(all sources alike) and 1 (as they are), is found by bisection: either the smallest at which no source is
repeated more than ``max_repeats`` times, or the one at which the weights have ``target_entropy`` (nats).
The budget is the smallest at which no document is left out, so the source that is most over-represented
is read once and the others as often as their weight asks for.

A source's stream is one permutation of its documents after the other, each in the order of a hash. The
last permutation is cut where the source's token budget ends: whole hash ranges first, then single
documents within one range, so that no task orders a whole source. The mixture is cut into BLOCKS blocks;
each holds every source in proportion to its weight, in a random order. :func:`mixture` gives each row its
place in its block, counted by hash ranges and then within one range; :func:`mix_documents` returns the
documents in that order, block after block.

Built-in functions only. Weights are computed row by row of the table of sources from a few sums over it,
so there may be as many sources as hosts; sources that many rows have are joined apart
(:func:`pathlode.llm.common.spread_join`).

Defined cases: null sources are one source; null and empty texts have no tokens and stay once in each
permutation; a source without any token keeps each document once; equal rows are taken or left together
in the last permutation; rows whose hashes tie are ordered by id, then by place in the table; a target
entropy that not even the sources as they are go down to leaves the shares as they are; texts are only
counted, so their length does not matter; an empty table gives no rows; other columns are kept by
:func:`mix_documents`, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathlode.llm.common import SPACE_CLASS, let, materialize, spread_join

RANGE_BITS, BLOCKS, STEPS, GRID = 12, 64, 60, 32
#: Default limit of the repetition of a source.
MAX_REPEATS = 2.0
_UNIT = float(1 << 63)


def count_tokens(text: Column) -> Column:
    """Words of a text."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+")
    return let(parts, lambda p: F.size(p) - (F.get(p, F.lit(0)) == "").cast("int") - ((F.size(p) > 1) & (F.get(p, F.size(p) - 1) == "")).cast("int")).cast("long")


def source_key(source: Column) -> Column:
    """A join key for sources that tells null from every string."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def place_of(columns: list[Column], seed: int) -> Column:
    """A row's place in its source's permutation: a hash from 0 up to 2**63."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 1)


def _bisect(test) -> float:
    """The smallest exponent in [0, 1] for which ``test`` holds; it is taken to hold at 1 and is monotone."""
    if test(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        middle = (low + high) / 2
        low, high = (low, middle) if test(middle) else (middle, high)
    return high


def _bisect_many(test_many) -> float:
    """As :func:`_bisect`, with GRID exponents tested at once: each round is one pass over the sources."""
    low, high = 0.0, 1.0
    while high - low > 2.0**-50:
        grid = [low + (high - low) * k / GRID for k in range(GRID)]
        held = test_many(grid)
        first = held.index(True) if True in held else GRID
        if first == 0:
            return grid[0]
        low, high = grid[first - 1], grid[first] if first < GRID else high
    return high


def weights(totals: DataFrame, max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None) -> DataFrame:
    """One row for each source of ``totals`` (key, tokens, n) that has tokens: key, tokens, n, share, exponent, weight, epochs.

    ``epochs`` is how often the source is read within the budget, 1 at least. ``totals`` should be a written
    table; only sums over it come to the driver.
    """
    some = totals.where("tokens > 0")
    sums = some.agg(F.sum("tokens").alias("total"), F.max("tokens").alias("most"), F.min("tokens").alias("least")).first()
    if sums.total is None:
        return some.select("key", "tokens", "n", *[F.lit(0.0).alias(c) for c in ("share", "exponent", "weight", "epochs")])
    share = F.col("tokens") / F.lit(float(sums.total))

    def powers(a: float) -> tuple[Column, Column]:
        return F.sum(F.pow(share, F.lit(a))), F.sum(F.pow(share, F.lit(a)) * F.log(share))

    if target_entropy is not None:

        def holds(grid: list[float]) -> list[bool]:
            row = some.agg(*[c for a in grid for c in powers(a)]).first()
            return [math.log(row[2 * k]) - a * row[2 * k + 1] / row[2 * k] <= target_entropy for k, a in enumerate(grid)]

        exponent = _bisect_many(holds)
    else:
        limit = max_repeats if max_repeats is not None else math.inf
        exponent = _bisect(lambda a: (sums.most / sums.least) ** (1 - a) <= limit)
    z = some.agg(powers(exponent)[0]).first()[0]
    return some.select(
        "key",
        "tokens",
        "n",
        share.alias("share"),
        F.lit(exponent).alias("exponent"),
        (F.pow(share, F.lit(exponent)) / F.lit(z)).alias("weight"),
        F.greatest(F.lit(1.0), F.pow(F.lit(float(sums.most)) / F.col("tokens"), F.lit(1 - exponent))).alias("epochs"),
    )


def plan_mix(docs: DataFrame, source: str, id_col: str, text: str, seed: int, **goal: float | None) -> tuple[DataFrame, DataFrame]:
    """(rows, plan): a written table of rows without texts, and for each source its epochs and last cut."""
    slim = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{source}`").cast("string").alias("source"),
        count_tokens(F.col(f"`{text}`")).alias("tokens"),
        place_of([F.col(f"`{id_col}`"), F.col(f"`{text}`")], seed).alias("place"),
        F.monotonically_increasing_id().alias("rid"),
    )
    rows = materialize(slim.withColumn("key", source_key(F.col("source"))).withColumn("span", _span(F.col("place"))), "mix")
    ranges = materialize(rows.groupBy("key", "span").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")), "ranges")
    totals = materialize(ranges.groupBy("key").agg(F.sum("tokens").alias("tokens"), F.sum("n").alias("n")), "totals")
    weight = materialize(weights(totals, **goal), "weights")

    whole = F.floor(F.col("epochs") + 1e-9)
    cut = weight.select("key", "n", "share", "exponent", "weight", "epochs", whole.cast("int").alias("whole"), (F.greatest(F.lit(0.0), F.col("epochs") - whole) * F.col("tokens")).alias("goal"))
    before = F.sum("tokens").over(Window.partitionBy("key").orderBy("span")) - F.col("tokens")
    placed = ranges.withColumn("before", before).join(cut.select("key", "goal"), "key").where("goal > 0")
    edge = materialize(placed.where("before <= goal and goal < before + tokens").select("key", "span", "n", "before", "goal"), "edges")
    inside = spread_join(rows.select("key", "span", "place", "tokens"), edge, ["key", "span"], "n").groupBy("key", "place", "before", "goal").agg(F.sum("tokens").alias("tokens"))
    reached = F.col("before") + F.sum("tokens").over(Window.partitionBy("key").orderBy("place"))
    taken = inside.withColumn("reached", reached).where("reached <= goal").groupBy("key").agg(F.max("place").alias("last"))
    start_of_edge = edge.select("key", (F.shiftleft(F.col("span").cast("long"), 63 - RANGE_BITS) - 1).alias("floor"))
    plan = cut.join(start_of_edge, "key", "left").join(taken, "key", "left").select("key", "n", "share", "exponent", "weight", "epochs", "whole", F.coalesce("last", "floor", F.lit(-1)).cast("long").alias("last"))
    return rows, materialize(plan, "plan")


def _span(place: Column) -> Column:
    return F.shiftright(place, 63 - RANGE_BITS).cast("int")


def _copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows (with key, place and rid) once for each permutation that they are in.

    Adds the plan's columns, copies, epoch, block, and ``turn``: the hash that orders a block.
    """
    joined = spread_join(rows, plan, ["key"], "n", "left")
    n = F.coalesce(F.col("whole") + (F.col("place") <= F.col("last")).cast("int"), F.lit(1))
    out = joined.withColumn("copies", n).withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    full = F.col("epoch") <= F.col("whole")
    own = F.shiftrightunsigned(F.xxhash64("place", "epoch"), 1)
    at = F.when(full, F.col("epoch") - 1 + own / _UNIT).otherwise(F.col("whole") + (F.col("epochs") - F.col("whole")) * F.col("place") / (F.col("last") + 1.0))
    # a source without tokens has no plan: its rows are dealt to the blocks by their hash
    block = F.coalesce(F.floor(BLOCKS * at / F.col("epochs")), F.floor(BLOCKS * (own / _UNIT)))
    return out.withColumn("block", F.least(F.lit(BLOCKS - 1), block).cast("int")).withColumn("turn", F.shiftrightunsigned(F.xxhash64("place", "epoch", "rid"), 1))


def mixture(docs: DataFrame, source: str = "source", id_col: str = "doc_id", text: str = "text", seed: int = 7, max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None) -> DataFrame:
    """The mixture without texts: doc_id, source, tokens, epoch, copies, exponent, weight, block, place_in_block.

    ``place_in_block`` counts from 0 without gaps: the rows of the block in earlier ranges of ``turn``,
    and then the rank within the range.
    """
    rows, plan = plan_mix(docs, source, id_col, text, seed, max_repeats=max_repeats, target_entropy=target_entropy)
    out = materialize(_copies(rows, plan).select("doc_id", "source", "tokens", "epoch", "copies", "exponent", "weight", "block", "turn", "rid", _span(F.col("turn")).alias("part")), "mixture")
    counts = out.groupBy("block", "part").agg(F.count("*").alias("c"))
    start = F.sum("c").over(Window.partitionBy("block").orderBy("part")) - F.col("c")
    starts = counts.select("block", "part", start.alias("start"))
    rank = F.row_number().over(Window.partitionBy("block", "part").orderBy("turn", F.col("doc_id").asc_nulls_last(), "rid", "epoch")) - 1
    placed = out.withColumn("rank", rank).join(starts, ["block", "part"])
    return placed.select("doc_id", "source", "tokens", "epoch", "copies", "exponent", "weight", "block", (F.col("start") + F.col("rank")).cast("long").alias("place_in_block"))


def mix_documents(docs: DataFrame, source: str = "source", id_col: str = "doc_id", text: str = "text", seed: int = 7, max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None) -> DataFrame:
    """The documents of the mixture, each as often as it is read, with the columns of ``docs``.

    They come in the order of :func:`mixture`: partitions follow the blocks, and each is sorted. This deals
    every text once, which is what mixing is.
    """
    _, plan = plan_mix(docs, source, id_col, text, seed, max_repeats=max_repeats, target_entropy=target_entropy)
    whole_row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(whole_row, source_key(F.col(f"`{source}`")).alias("key"), place_of([F.col(f"`{id_col}`"), F.col(f"`{text}`")], seed).alias("place"), F.monotonically_increasing_id().alias("rid"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.least(F.lit(parts - 1), F.floor(parts * (F.col("block") + F.col("turn") / _UNIT) / BLOCKS).cast("int"))
    dealt = _copies(rows, plan).select("row", "block", "turn", "rid", "epoch").repartitionById(parts, part)
    ordered = dealt.sortWithinPartitions("block", "turn", F.col(f"row.`{id_col}`").cast("long").asc_nulls_last(), "rid", "epoch")
    return ordered.select("row.*")
