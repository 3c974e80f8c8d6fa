"""Exact Jaccard join of shingle sets by partition of the universe.

Sets with a Jaccard similarity of at least t differ in at most H = (1-t)/(1+t) * (a+b) shingles.
Shingles are hashed into H + 1 segments, H being that of the size band; so some segment of two
linked sets is equal (pigeonhole). Sets whose segment holds less than two shingles would meet all
others there; the allocation therefore spends nothing on such segments and makes up for
each with a segment in which one difference is allowed: there the subset and its
one-deletion neighbourhood are indexed. How many segments are indexed so follows from the number of
small segments expected in the band. A set with more small segments than that also indexes
those; two such sets meet as plain pigeonhole says, and of any other two linked sets at least one
finds the other by its own allocation.

Equal sets are one class. In a group of classes with the same signature only links with the group's
first class are verified at first; classes that are then connected need no test among
themselves, and only what is left unconnected in a group is tested across components.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from salescope.llm.common import dropping_shuffles, map_batches, release, stored
from salescope.llm.components import connected_components

SHINGLE, SHARE = 4, 85  # words of a shingle; per cent
BAND = 1.25  # sizes in a band differ by this factor at most
WIDE, WIDE_FROM = 2_048, 96  # bits of the wide sketch, and shingles from which a set has one
SEEN = 200_000  # sets that a task remembers so as not to index equal ones again
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def words_of(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased words between white space (space, 0x09 to 0x0D)."""
    return text.lower().split() if text else []


def shingle_set(text: bytes | None, size: int = SHINGLE) -> set[bytes]:
    words = words_of(text)
    if len(words) <= size:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[i:] for i in range(size)))))


def shingle_hashes(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(size, len(words))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = _mixed(out * _M1 + h[i : i + len(out)])
    return np.unique(out)


def set_digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def parity(hashes: np.ndarray) -> np.ndarray:
    """256 parities of shingles dealt by hash, as 4 longs; they differ in at most as many bits as the sets in shingles."""
    bits = np.bincount((_mixed(hashes) & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(bits.astype(np.uint8)).view("<i8")


def wide_parity(hashes: np.ndarray) -> np.ndarray | None:
    """``WIDE`` further parities as longs, for sets that 256 cannot tell apart; None for smaller ones."""
    if len(hashes) < WIDE_FROM:
        return None
    bits = np.bincount((_mixed(hashes ^ _M2) % np.uint64(WIDE)).astype(np.int64), minlength=WIDE) & 1
    return np.packbits(bits.astype(np.uint8)).view("<i8")


class Bands:
    """Size bands with their numbers of segments, and of segments that allow a deletion."""

    def __init__(self, share: int = SHARE, growth: float = BAND):
        self.share, self.growth = share, growth
        self.lows = [1]

    def of(self, size: int) -> int:
        while self.lows[-1] <= size:
            self.lows.append(max(self.lows[-1] + 1, int(self.lows[-1] * self.growth) + 1))
        return int(np.searchsorted(self.lows, size, side="right")) - 1

    def difference(self, a: int, b: int) -> int:
        return (100 - self.share) * (a + b) // (100 + self.share)

    @functools.lru_cache(maxsize=4096)  # noqa: B019
    def plan(self, band: int) -> tuple[int, int]:
        """(segments, segments that allow a deletion); no segment where only equal sets link."""
        high = self.lows[band + 1] - 1
        most = self.difference(high, high * 100 // self.share)
        if most == 0:
            return 0, 0
        segments = most + 1
        filled = self.lows[band] / segments * 1.1
        small = segments * math.exp(-filled) * (1 + filled)
        return segments, min(segments, 1 + round(1.5 * small))


def signatures(hashes: np.ndarray, bands: Bands) -> np.ndarray:
    """Signatures of a set under its own band and, if smaller sets there can link, the one below."""
    size = len(hashes)
    own = bands.of(size)
    out = []
    for band in (own, own - 1):
        if band < 0 or band < own and bands.lows[own] - 1 < -(-size * bands.share // 100):
            continue
        segments, lenient = bands.plan(band)
        if not segments:
            continue
        salt = np.uint64((band + 1) * 0x1000193)
        mixed = _mixed(hashes + np.uint64(int(salt) * int(_M1) % 2**64))
        place = (mixed % np.uint64(segments)).astype(np.int64)
        value = _mixed(mixed ^ _M3)
        counts = np.bincount(place, minlength=segments)
        sums = np.zeros(segments, np.uint64)
        np.add.at(sums, place, value)
        head = (np.arange(segments, dtype=np.uint64) + salt * np.uint64(1 << 20)) * _M1
        needy = (counts[:lenient] >= 3).sum() < (counts < 2).sum()
        kept = np.flatnonzero((counts >= 2) | needy)
        out.append(_mixed(head[kept] + sums[kept] + counts[kept].astype(np.uint64) * _M2))
        less = np.flatnonzero((place < lenient) & (counts[place] >= 3))
        at = place[less]
        out.append(_mixed(head[at] + sums[at] - value[less] + (counts[at] - 1).astype(np.uint64) * _M2))
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)


_PRINTS = "doc_id long, n_shingles long, digest binary, p0 long, p1 long, p2 long, p3 long, wide array<long>"


def _prints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, parities, wide = [], [], [], []
            for text in batch.column(1).to_pylist():
                hashes = shingle_hashes(text, shingle)
                sizes.append(len(hashes))
                digests.append(set_digest(hashes) if len(hashes) else None)
                parities.append(parity(hashes))
                wide.append(wide_parity(hashes))
            bits = np.array(parities, dtype=np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), *(pa.array(np.ascontiguousarray(bits[:, i])) for i in range(4)), pa.array(wide, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "digest", "p0", "p1", "p2", "p3", "wide"],
            )

    return run


def _signed(shingle: int, share: int):
    schema = pa.schema([("sig", pa.int64()), ("doc", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(share), set()
        for batch in batches:
            sigs, docs = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hashes = shingle_hashes(text, shingle)
                digest = set_digest(hashes)
                if not len(hashes) or digest in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(digest)
                own = signatures(hashes, bands)
                sigs.append(own)
                docs.append(np.full(len(own), doc, np.int64))
                if sum(map(len, sigs[-64:])) > 60_000 or len(sigs) > 2_000:
                    yield _pairs_batch(sigs, docs, schema)
                    sigs, docs = [], []
            yield _pairs_batch(sigs, docs, schema)

    return run


def _pairs_batch(sigs: list[np.ndarray], docs: list[np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    flat = np.concatenate(sigs).view(np.int64) if sigs else np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.concatenate(docs) if docs else np.empty(0, np.int64))], schema=schema)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (sig, doc): (sig, leader, doc) for every document but the first of its signature."""
    sig, leader = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        sigs, docs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        first = np.empty(len(sigs), bool)
        first[1:] = sigs[1:] != sigs[:-1]
        first[0] = sig is None or sigs[0] != sig
        place = np.maximum.accumulate(np.where(first, np.arange(len(sigs)), -1))
        leaders = np.where(place >= 0, docs[np.maximum(place, 0)], leader if leader is not None else 0)
        sig, leader = sigs[-1], leaders[-1]
        kept = ~first & (docs != leaders)
        yield pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in (sigs, leaders, docs)], names=["sig", "leader", "doc"])


def _can_link(share: int, one: str = "a", two: str = "b") -> Column:
    """Neither sizes nor parities rule the pair out."""
    a, b = F.col(f"{one}_n"), F.col(f"{two}_n")
    apart = sum(F.bit_count(F.col(f"{one}_p{i}").bitwiseXOR(F.col(f"{two}_p{i}"))) for i in range(4))
    bits = F.zip_with(f"{one}_w", f"{two}_w", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    further = F.coalesce(F.aggregate(bits, F.lit(0), lambda total, n: total + n), F.lit(0))  # a set without a wide sketch fits all
    within = lambda least: (100 + share) * least <= (100 - share) * (a + b)
    return (100 * F.least(a, b) >= share * F.greatest(a, b)) & within(apart) & within(further)


def _verified(shingle: int, share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, set[bytes]] = {}

        def shingles(doc: int, text: bytes) -> set[bytes]:
            if doc not in held:
                if len(held) >= 32:
                    held.pop(next(iter(held)))
                held[doc] = shingle_set(text, shingle)
            return held[doc]

        for batch in batches:
            links = []
            for a, b, one, two in zip(*(batch.column(n).to_pylist() for n in ("a", "b", "one", "two"))):
                x, y = shingles(a, one), shingles(b, two)
                common = len(x & y)
                links.append(100 * common >= share * (len(x) + len(y) - common))
            mask = pa.array(links, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return run


def _texts(docs: DataFrame, reps: DataFrame, shingle: int) -> DataFrame:
    """Stored (doc, text) of the given classes' first documents; the row is the one whose set is the class's."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("text").to_pylist(), batch.column("digest").to_pylist())
            kept = pa.array([set_digest(shingle_hashes(text, shingle)) == digest for text, digest in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("doc").filter(kept), batch.column("text").filter(kept)], names=["doc", "text"])

    wanted = docs.join(reps.select(F.col("rep").alias("doc_id"), "digest"), "doc_id").select(F.col("doc_id").alias("doc"), "text", "digest")
    return stored(map_batches(wanted, run, "doc long, text binary").dropDuplicates(["doc"]), "candidate-texts")


def _links(docs: DataFrame, pairs: DataFrame, classes: DataFrame, shingle: int, share: int) -> DataFrame:
    """Stored (a, b) of the pairs of classes that link, compared shingle by shingle."""
    ends = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
    texts = _texts(docs, classes.select("rep", "digest").join(ends, "rep", "left_semi"), shingle)
    joined = pairs.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("one")), "a").join(
        texts.select(F.col("doc").alias("b"), F.col("text").alias("two")), "b"
    )
    return stored(map_batches(joined.select("a", "b", "one", "two"), _verified(shingle, share), "a long, b long"), "verified")


def _with_sketch(pairs: DataFrame, classes: DataFrame, name: str) -> DataFrame:
    columns = {"rep": name, "n_shingles": f"{name}_n", "wide": f"{name}_w", **{f"p{i}": f"{name}_p{i}" for i in range(4)}}
    return pairs.join(classes.select(*[F.col(k).alias(v) for k, v in columns.items()]), name)


@dropping_shuffles
def similar_groups(docs: DataFrame, shingle: int = SHINGLE, share: int = SHARE) -> DataFrame:
    """(doc_id, digest, n_shingles, component_id) for every row of ``docs`` (doc_id, text).

    Two documents link when their sets of word shingles have ``100 * common >= share * union``; the
    component is the smallest doc_id reachable by links. A text of fewer words than a
    shingle is one shingle; null, empty and blank texts have none and link with nothing, nor
    do rows with a null doc_id, whose component is null. Rows that repeat a doc_id are
    parts of one document: they share a component and each has its own count. Other
    columns are not read.
    """
    release(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    prints = stored(map_batches(texts, _prints(shingle), _PRINTS), "prints")
    named = prints.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    sketch = [F.first(c).alias(c) for c in ("n_shingles", "p0", "p1", "p2", "p3", "wide")]
    classes = stored(named.groupBy("digest").agg(F.min("doc_id").alias("rep"), *sketch), "classes")
    member = stored(named.select("doc_id", "digest").distinct().join(classes.select("digest", "rep"), "digest").select("doc_id", "rep"), "members")

    texts = texts.where("doc_id IS NOT NULL AND text IS NOT NULL")
    signed = map_batches(texts, _signed(shingle, share), "sig long, doc long")
    groups = stored(map_batches(signed.repartition("sig").sortWithinPartitions("sig", "doc"), _grouped, "sig long, leader long, doc long"), "signature-groups")
    del signed
    release(docs.sparkSession)  # the signatures are by far the largest shuffle
    first = groups.select("leader", "doc").distinct()
    rep_of = lambda column: member.select(F.col("doc_id").alias(column), F.col("rep").alias(f"{column}_rep"))
    stars = first.join(rep_of("leader"), "leader").join(rep_of("doc"), "doc")
    pairs = stars.select(F.least("leader_rep", "doc_rep").alias("a"), F.greatest("leader_rep", "doc_rep").alias("b")).where("a < b").distinct()
    possible = stored(
        _with_sketch(_with_sketch(pairs, classes, "a"), classes, "b").where(_can_link(share)).select("a", "b"), "pairs"
    )
    # a doc_id whose rows have several sets ties their classes together
    tied = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b")
    tied = member.join(tied.select("doc_id", "a"), "doc_id").select("a", F.col("rep").alias("b")).where("a < b")
    links = stored(_links(texts, possible, classes, shingle, share).unionByName(tied).distinct(), "links-found")
    release(docs.sparkSession)
    labels = connected_components(links)

    component = lambda name: labels.select(F.col("node").alias(f"{name}_rep"), F.col("component").alias(f"{name}_c"))
    placed = (
        groups.join(rep_of("leader"), "leader").join(rep_of("doc"), "doc")
        .join(component("leader"), "leader_rep", "left").join(component("doc"), "doc_rep", "left")
        .withColumn("leader_c", F.coalesce("leader_c", "leader_rep")).withColumn("doc_c", F.coalesce("doc_c", "doc_rep"))
    )
    apart = placed.where("leader_c <> doc_c").select("sig").distinct()
    rest = placed.join(apart, "sig", "left_semi")
    rest = stored(
        rest.select("sig", F.col("doc_rep").alias("rep"), F.col("doc_c").alias("c"))
        .unionByName(rest.select("sig", F.col("leader_rep").alias("rep"), F.col("leader_c").alias("c"))).distinct(),
        "groups-apart",
    )
    if not rest.isEmpty():
        release(docs.sparkSession)
        left = _with_sketch(rest.select("sig", F.col("rep").alias("a"), F.col("c").alias("ac")), classes, "a")
        right = _with_sketch(rest.select("sig", F.col("rep").alias("b"), F.col("c").alias("bc")), classes, "b")
        across = left.join(right, "sig").where(F.col("ac") != F.col("bc")).where(F.col("a") < F.col("b")).where(_can_link(share))
        untried = stored(across.select("a", "b").distinct().join(possible, ["a", "b"], "left_anti"), "pairs-apart")
        more = _links(texts, untried, classes, shingle, share)
        if not more.isEmpty():
            labels = connected_components(links.unionByName(more))
    whole = prints.join(classes.select("digest", "rep"), "digest", "left").join(
        labels.select(F.col("node").alias("rep"), "component"), "rep", "left"
    )
    alone = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component", "rep", "doc_id"))
    return whole.select("doc_id", "digest", "n_shingles", alone.alias("component_id"))
