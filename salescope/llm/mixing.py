"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks of words.

Targets: sources share a total by weight; none gets more than ``MOST`` times its own words, and what it leaves
is shared among the rest. The total is cut into blocks of equally many words, which go to the sources
by the highest quotients weight / (2k + 1). A source's documents are dealt to shards of bounded size, and its
blocks go to the shards by the same rule, down a tree of at most ``FAN`` children a node, so no task
ranks all shards of a large source. In a shard the documents lie one after another in seeded order; the
blocks of this sequence with the least seeded digests are taken once more than the others.

Only columns of numbers and digests are shuffled, and all of it is DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from salescope.llm.common import stored

WEIGHTS = (5, 2, 1)  # of the sources in order, repeating
SHARE = 150  # per cent of all words that the mix holds
MOST = 2  # times that a word is taken at most
BLOCK = 64  # words of a block at most
FINEST = 1_000  # blocks that the smallest target below its limit has at least, down to blocks of one word
SHARD = 1_024  # blocks of a shard, on average
SHARD_ROWS = 50_000  # rows of a shard, on average at most
FAN = 256  # children of a node of the tree of shards
SEED = "mix"


def word_count(text: Column) -> Column:
    """Words between white space; 0 for null."""
    spaced = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    gaps = F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))
    return F.when(spaced == "", 0).otherwise(gaps + 1).cast("long")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def apportion(parts: DataFrame, group: list[str], child: str, weight: str, seats: str) -> DataFrame:
    """``parts`` with ``quota``: the ``seats`` of every group by the highest quotients weight / (2k + 1).

    (group, child) is a key of ``parts``; ``seats`` is the same in all rows of a group. Ties go to the smaller child.
    By Sainte-Laguë a part's seats differ from its exact share v by at most 1/2 + v * parts / (2 * seats), so only
    the quotients within that are ranked. A group without weight has no seats.
    """
    whole = Window.partitionBy(*group)
    share = F.col(seats) * F.col(weight) / F.col("_sum")
    slack = share * F.col("_parts") / (2.0 * F.col(seats)) + 0.5
    usable = (F.col("_sum") > 0) & (F.col(seats) > 0)
    bounded = (
        parts.withColumns({"_sum": F.sum(weight).over(whole), "_parts": F.count("*").over(whole)})
        .withColumn("_low", F.when(usable, F.greatest(F.lit(0), F.ceil(share - slack - 1e-6))).otherwise(0).cast("long"))
        .withColumn("_high", F.when(usable, F.floor(share + slack + 1e-6) + 1).otherwise(0).cast("long"))
        .withColumn("_left", F.when(usable, F.col(seats) - F.sum("_low").over(whole)).otherwise(0))
    )
    ranked = bounded.withColumn("_k", F.explode(F.when(F.col("_high") > F.col("_low"), F.sequence("_low", F.col("_high") - 1)).otherwise(F.array(F.lit(None).cast("long")))))
    best = Window.partitionBy(*group).orderBy(F.desc_nulls_last(F.col(weight) / (2 * F.col("_k") + 1)), F.asc(child))
    won = ranked.withColumn("_won", (F.row_number().over(best) <= F.col("_left")) & F.col("_k").isNotNull())
    names = parts.columns
    return won.groupBy(*names).agg((F.first("_low") + F.sum(F.col("_won").cast("long"))).alias("quota"))


def _source_targets(sizes: DataFrame, weights: tuple[int, ...], share: int, most: int) -> DataFrame:
    """One row per source: number by code point, weight, target, whether it is at its limit, words of a block.

    Works on one row per source, so its windows are small.
    """
    every = Window.partitionBy(F.lit(0))
    scale = math.lcm(*weights)
    numbered = sizes.withColumn("source_no", F.row_number().over(every.orderBy(F.asc_nulls_last("source"))) - 1)
    weighed = numbered.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), F.col("source_no") % len(weights) + 1))
    fullest = every.orderBy(F.col("source_size") * F.expr(f"{scale} div weight"), "source_no")
    before = fullest.rowsBetween(Window.unboundedPreceding, -1)
    wide = lambda c: c.cast("decimal(38,0)")
    rest = wide(share * F.sum("source_size").over(every) - 100 * most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    limited = weighed.withColumn("limited", wide(100 * most * F.col("source_size")) * wide(open_weight) <= wide(F.col("weight")) * rest)
    spare = share * F.sum("source_size").over(every) - 100 * most * F.sum(F.when(F.col("limited"), F.col("source_size")).otherwise(0)).over(every)
    heavy = F.sum(F.when(F.col("limited"), 0).otherwise(F.col("weight"))).over(every)
    target = F.when(F.col("limited"), (most * F.col("source_size")).cast("double")).otherwise(F.col("weight") * spare / (100.0 * heavy))
    aimed = limited.withColumn("target", target)
    least = F.min(F.when(~F.col("limited"), F.col("target"))).over(every)
    block = F.coalesce(F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(least / FINEST))), F.lit(BLOCK)).cast("long")
    return aimed.withColumn("block", block).withColumn("all_seats", F.round(F.sum(F.when(~F.col("limited"), F.col("target")).otherwise(0)).over(every) / F.col("block")).cast("long"))


def _shard_quotas(shards: DataFrame, sources: DataFrame) -> DataFrame:
    """``quota`` of every (source_no, shard), from the source's seats down the tree of shards."""
    depth, most_shards = 1, sources.agg(F.max("n_shards")).first()[0] or 1
    while FAN**depth < most_shards:
        depth += 1
    level = sources.select("source_no", F.lit(0).cast("long").alias("node"), "quota")
    for step in range(depth):
        width = FAN ** (depth - step - 1)
        node = _div(F.col("shard"), F.lit(width)).alias("node")
        sizes = shards.groupBy("source_no", node).agg(F.sum("words").alias("words")).withColumn("parent", _div(F.col("node"), F.lit(FAN)))
        seats = level.select("source_no", F.col("node").alias("parent"), F.col("quota").alias("seats"))
        parts = sizes.join(seats, ["source_no", "parent"])
        level = apportion(parts, ["source_no", "parent"], "node", "words", "seats").select("source_no", "node", "quota")
    return level.withColumnRenamed("node", "shard")


def _digest(*parts) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, spans) for every row of ``docs`` (doc_id, text, source).

    ``size`` counts words, ``target`` is the words that the row's source is to give, ``taken`` those that the mix
    takes from the row, repeats counted, and ``spans`` where: (first word from 0, words, times), in order.
    Sources weigh by code point, null last. A null or empty text has no words, and nothing is taken.
    Repeated rows are rows of their own, and an id need not be unique or not null. Other columns are
    not read. An empty table gives no rows. The result depends on the rows and the seed only.
    """
    units = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies")), "mix-units")
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("source_rows"))
    aimed = _source_targets(sizes, weights, share, most)
    n_shards = F.ceil(F.greatest(F.col("source_size") / (F.col("block") * SHARD), F.col("source_rows") / SHARD_ROWS, F.lit(1.0)))
    open_sources = apportion(aimed.withColumn("nothing", F.lit(0)).withColumn("claim", F.when(F.col("limited"), 0).otherwise(F.col("weight"))), ["nothing"], "source_no", "claim", "all_seats")
    sources = stored(open_sources.withColumn("n_shards", n_shards.cast("long")), "mix-sources")

    # Copies of a row beyond a quarter of a shard go to other shards.
    held = F.greatest(F.lit(1), F.least(F.expr(f"block * {SHARD} div (4 * greatest(size, 1))"), F.lit(SHARD_ROWS // 4))).cast("long")
    wanted = sources.select(F.col("source").alias("_source"), "source_no", "block", "n_shards")
    pieces = (
        units.join(wanted, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("held", held)
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(copies - 1) div held"))))
        .withColumn("copies", F.least(F.col("held"), F.col("copies") - F.col("piece") * F.col("held")))
        .withColumn("key", _digest(F.lit(seed), F.col("doc_id"), F.col("piece")))
        .withColumn("shard", F.conv(F.substring("key", 1, 12), 16, 10).cast("long") % F.col("n_shards"))
    )
    order = Window.partitionBy("source_no", "shard").orderBy("key", "doc_id", "size", "piece").rowsBetween(Window.unboundedPreceding, -1)
    laid = stored(
        pieces.withColumn("begin", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(order), F.lit(0)))
        .select("doc_id", "source_no", "shard", "size", "copies", "begin"),
        "mix-pieces",
    )
    shards = laid.groupBy("source_no", "shard").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    given = sources.select("source", "source_no", "source_size", "target", "limited", "block")
    chosen = (
        shards.join(_shard_quotas(shards, sources), ["source_no", "shard"])
        .join(given, "source_no")
        .withColumn("blocks", F.ceil(F.col("words") / F.col("block")).cast("long"))
        .withColumn("quota", F.when(F.col("limited"), most * F.col("blocks")).otherwise(F.least(F.col("quota"), most * F.col("blocks"))))
        .withColumn("always", F.when(F.col("blocks") > 0, F.expr("quota div greatest(blocks, 1)")).otherwise(0))
        .withColumn("extra", F.when(F.col("blocks") > 0, F.expr("quota % greatest(blocks, 1)")).otherwise(0).cast("int"))
    )
    digests = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda b: _digest(F.lit(seed), F.col("source_no"), F.col("shard"), b))
    chosen = chosen.withColumn("limit", F.when(F.col("extra") > 0, F.element_at(F.array_sort(digests), F.col("extra"))))
    placed = (
        laid.join(chosen.select("source_no", "shard", "source", "source_size", "target", "block", "always", "limit"), ["source_no", "shard"])
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        .withColumn("begin", F.col("begin") + F.col("copy") * F.col("size"))
        .withColumn("end", F.col("begin") + F.col("size"))
    )

    def span(b: Column) -> Column:
        first = F.greatest(F.col("begin"), b * F.col("block"))
        last = F.least(F.col("end"), (b + 1) * F.col("block"))
        chance = F.when(_digest(F.lit(seed), F.col("source_no"), F.col("shard"), b) <= F.col("limit"), 1).otherwise(0)
        return F.struct((first - F.col("begin")).alias("first"), (last - first).alias("words"), (F.col("always") + chance).alias("times"))

    touched = F.when(F.col("size") > 0, F.sequence(F.expr("begin div block"), F.expr("(end - 1) div block"))).otherwise(F.array().cast("array<bigint>"))
    cut = placed.withColumn("spans", F.filter(F.transform(touched, span), lambda s: s["times"] > 0))
    taken = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["words"] * s["times"])
    return cut.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "spans")


def taken_text(text: Column, spans: Column) -> Column:
    """The words that the mix takes of a text, joined by one space: each span as often as it is taken."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    again = F.transform(spans, lambda s: F.flatten(F.array_repeat(F.slice(words, (s["first"] + 1).cast("int"), s["words"].cast("int")), s["times"].cast("int"))))
    return F.array_join(F.flatten(again), " ")
