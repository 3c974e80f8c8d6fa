"""Audit chains of several shards a day, under a tree of hashes.

A day's entries are chained within shards, so that a busy day is walked by as many tasks as it has shards. Over each shard's
entries, and over the shards of a day, stands a tree in which every node is the hash of at most ``FAN`` nodes below it.
Two trees are compared from the day down, along differing nodes only; an entry is proved by its siblings on
the way up, a list that grows with the logarithm of the day.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from salescope.operators.audit import build_chain, check_entries
from salescope.session import materialise

FAN = 16
_TREE = ["log_date", "shard", "level", "node", "hash"]


def sharded_chain(entries: DataFrame, secret: str, order: Sequence[str], shards: int = 16, shard: Column | None = None) -> DataFrame:
    """(log_date, shard, seq, payload, prev_hash, hash): the entries chained within each shard of a day, in the given order.

    An entry's shard is ``shard``, by default a hash of the ``order`` columns, modulo ``shards``. With one shard
    payloads and hashes are those of ``build_chain``.
    """
    number = F.pmod(F.xxhash64(*order) if shard is None else shard, F.lit(shards)).cast("int")
    named = entries.withColumn("chain", F.concat_ws("/", F.col("log_date").cast("string"), number.cast("string")))
    chained = build_chain(named, secret, order, day="chain")
    parts = F.split("chain", "/")
    return chained.select(parts[0].cast("date").alias("log_date"), parts[1].cast("int").alias("shard"), "seq", "payload", "prev_hash", "hash")


def broken_shards(chain: DataFrame, secret: str) -> DataFrame:
    """Per day and shard: entries, whether the chain is intact, and the first broken position."""
    ok = F.col("linked") & F.col("genuine")
    named = chain.withColumn("chain", F.concat_ws("/", F.col("log_date").cast("string"), F.col("shard").cast("string")))
    checked = check_entries(named, secret, day="chain").withColumn("parts", F.split("chain", "/"))
    return checked.groupBy(F.col("parts")[0].cast("date").alias("log_date"), F.col("parts")[1].cast("int").alias("shard")).agg(
        F.count("*").alias("entries"), F.bool_and(ok).alias("intact"), F.min(F.when(~ok, F.col("seq"))).alias("first_broken")
    )


def _levels(leaves: DataFrame, keys: list[str], fan: int) -> list[DataFrame]:
    """Stored levels (keys, node, hash) from the leaves up to one node for each key; at most ``fan`` hashes meet."""
    levels = [materialise(leaves.select(*keys, "node", "hash"), "hash-level")]
    last = levels[0].agg(F.max("node")).first()[0] or 0
    while last > 0:
        below = F.array_sort(F.collect_list(F.struct("node", "hash")))
        joined = levels[-1].groupBy(*keys, F.floor(F.col("node") / fan).alias("above")).agg(below.alias("below"))
        hashed = joined.select(*keys, F.col("above").alias("node"), F.sha2(F.array_join("below.hash", ""), 256).alias("hash"))
        levels.append(materialise(hashed, "hash-level"))
        last //= fan
    return levels


def hash_tree(chain: DataFrame, fan: int = FAN) -> DataFrame:
    """(log_date, shard, level, node, hash) of all nodes; a null shard marks the nodes above the shards of a day.

    A leaf is the hash of an entry's payload and its chain hash, at its position in the shard; the shards' roots
    are the leaves of the day. All days have the same number of levels, so a small shard's root is hashed again as the only node.
    """
    leaf = F.sha2(F.concat(F.coalesce("payload", F.lit("")), F.coalesce("hash", F.lit(""))), 256)
    own = _levels(chain.select("log_date", "shard", F.col("seq").alias("node"), leaf.alias("hash")), ["log_date", "shard"], fan)
    day = _levels(own[-1].select("log_date", F.col("shard").cast("long").alias("node"), "hash"), ["log_date"], fan)
    parts = [x.withColumn("level", F.lit(n)) for n, x in enumerate(own)]
    parts += [x.withColumns({"level": F.lit(n), "shard": F.lit(None).cast("int")}) for n, x in enumerate(day)]
    tree = parts[0].select(*_TREE)
    for part in parts[1:]:
        tree = tree.unionByName(part.select(*_TREE))
    return tree


def day_roots(tree: DataFrame) -> DataFrame:
    """(log_date, root)."""
    days = tree.where("shard IS NULL")
    return days.groupBy("log_date").agg(F.max_by("hash", "level").alias("root"))


def changed_entries(trusted: DataFrame, present: DataFrame, fan: int = FAN) -> DataFrame:
    """(log_date, shard, seq) of the entries that differ between two trees, were added or are gone.

    Only children of nodes that differ are compared. A tree of more levels than the other is compared from the lower top on.
    """
    def tops(tree: DataFrame) -> tuple[int, int]:
        row = tree.agg(F.max(F.when(F.col("shard").isNull(), F.col("level"))), F.max(F.when(F.col("shard").isNotNull(), F.col("level")))).first()
        return row[0] or 0, row[1] or 0

    def differing(level: int, shards: bool, parents: DataFrame | None) -> DataFrame:
        keys = ["log_date", "shard", "node"] if shards else ["log_date", "node"]
        sides = []
        for tree, name in ((trusted, "one"), (present, "two")):
            side = tree.where((F.col("level") == level) & (F.col("shard").isNotNull() if shards else F.col("shard").isNull()))
            if parents is not None:
                above = [*keys[:-1], F.floor(F.col("node") / fan).alias("parent")]
                side = side.select(*above, "node", "hash").join(parents, [*keys[:-1], "parent"], "left_semi")
            sides.append(side.select(*keys, F.col("hash").alias(name)))
        joined = sides[0].join(sides[1], keys, "full")
        # stored, as both sides of the level below read it
        return materialise(joined.where(~F.col("one").eqNullSafe(F.col("two"))).select(*keys), "differing")

    (day_a, own_a), (day_b, own_b) = tops(trusted), tops(present)
    found = None
    for level in range(min(day_a, day_b), -1, -1):
        found = differing(level, False, None if found is None else found.withColumnRenamed("node", "parent"))
    shards = found.select("log_date", F.col("node").cast("int").alias("shard"))
    low = min(own_a, own_b)
    found = differing(low, True, None).join(shards, ["log_date", "shard"], "left_semi")
    for level in range(low - 1, -1, -1):
        found = differing(level, True, found.withColumnRenamed("node", "parent"))
    return found.select("log_date", "shard", F.col("node").alias("seq"))


def inclusion_proof(tree: DataFrame, day: str, shard: int, seq: int, fan: int = FAN) -> list[tuple[int, list[str]]]:
    """From the entry up: its place among its siblings, and all of their hashes. At most ``fan`` a level are read."""
    proof = []
    here = tree.where(F.col("log_date") == F.to_date(F.lit(day)))
    for own in (True, False):
        nodes = here.where(F.col("shard") == shard) if own else here.where(F.col("shard").isNull())
        top, at = nodes.agg(F.max("level")).first()[0], seq if own else shard
        for level in range(top):
            first = at // fan * fan
            near = nodes.where((F.col("level") == level) & F.col("node").between(first, first + fan - 1)).orderBy("node").collect()
            proof.append(([r["node"] for r in near].index(at), [r["hash"] for r in near]))
            at //= fan
    return proof


def proves(payload: str, chain_hash: str, proof: list[tuple[int, list[str]]], root: str) -> bool:
    """Does the proof lead from the entry to the day's root?"""
    current = hashlib.sha256((payload + chain_hash).encode()).hexdigest()
    for place, siblings in proof:
        if siblings[place] != current:
            return False
        current = hashlib.sha256("".join(siblings).encode()).hexdigest()
    return current == root
