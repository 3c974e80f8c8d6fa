"""Benchmark decontamination over a distributed positional inverted index.

Every benchmark text is cut into windows of consecutive words. How often each benchmark
word occurs in the documents is counted; the rarest words of a window are its anchors. The
index holds the postings of anchors alone: (term, doc_id, positions). A window's lists, each
shifted by the word's offset in the window, are intersected beginning with the rarest; what is left is
confirmed word by word on the text, so that matches are exact.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from salescope.llm.common import map_batches, stored

# Words: runs of 0-9, a-z and everything beyond ASCII, after lower-casing A-Z.
_TO_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
WINDOW = 13
ANCHORS = 2
BLOCK_TERMS = 260_000  # words of the windows that one pass over the documents looks for


def item_words(text: bytes | None) -> list[bytes]:
    return text.translate(_TO_WORDS).split() if text else []


def window_digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


_WINDOWS = pa.schema([("item_id", pa.string()), ("digest", pa.binary()), ("terms", pa.list_(pa.binary()))])


def _cut(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = item_words(text)
                for at in range(max(1, len(words) - size + 1) if words else 0):
                    terms = words[at : at + size]
                    rows.append({"item_id": item, "digest": window_digest(terms), "terms": terms})
            yield pa.RecordBatch.from_pylist(rows, schema=_WINDOWS)

    return run


def benchmark_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, digest, terms) of every window; an item of fewer words, but not none, is one window."""
    texts = items.select(F.col("item_id").cast("string"), F.col("text").cast("binary"))
    return map_batches(texts, _cut(size), "item_id string, digest binary, terms array<binary>")


def _counts(terms: frozenset[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(filter(terms.__contains__, item_words(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

    return run


def term_counts(docs: DataFrame, terms: frozenset[bytes]) -> DataFrame:
    """(term, n): occurrences of the given terms in all documents."""
    found = map_batches(docs.select(F.col("text").cast("binary")), _counts(terms), "term binary, n long")
    return found.groupBy("term").agg(F.sum("n").alias("n"))


def _postings(terms: frozenset[bytes]):
    schema = pa.schema([("term", pa.binary()), ("doc_id", pa.int64()), ("positions", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_terms, out_docs, out_positions = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own: dict[bytes, list[int]] = {}
                words = item_words(text)
                if terms.isdisjoint(words):
                    continue
                for at, word in enumerate(words):
                    if word in terms:
                        own.setdefault(word, []).append(at)
                out_terms += own
                out_docs += [doc] * len(own)
                out_positions += own.values()
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_terms, pa.binary()), pa.array(out_docs, pa.int64()), pa.array(out_positions, pa.list_(pa.int32()))], schema=schema
            )

    return run


def _key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))


def positional_index(docs: DataFrame, terms: frozenset[bytes]) -> DataFrame:
    """Stored postings (term, doc_id, positions) of the given terms in all documents; null ids share the least number."""
    texts = docs.where("text IS NOT NULL").select(_key().alias("doc_id"), F.col("text").cast("binary"))
    return stored(map_batches(texts, _postings(terms), "term binary, doc_id long, positions array<int>"), "postings")


def _shifted(index: DataFrame, anchors: DataFrame, number: int) -> DataFrame:
    """(doc_id, digest, start): where a window would begin by its anchor of this number."""
    return (
        index.join(anchors.where(F.col("number") == number), "term")
        .select("doc_id", "digest", F.explode("positions").alias("at"), "offset")
        .select("doc_id", "digest", (F.col("at") - F.col("offset")).alias("start"))
        .where("start >= 0")
    )


def phrase_candidates(docs: DataFrame, windows: DataFrame, anchors: int = ANCHORS) -> DataFrame:
    """(doc_id, digest, start) where the ``anchors`` rarest terms of a window stand as in the window.

    ``windows`` (digest, terms) must have few enough terms for the Python workers.
    """
    placed = windows.select("digest", F.size("terms").alias("size"), F.posexplode("terms").alias("offset", "term"))
    terms = frozenset(bytes(r[0]) for r in placed.select("term").distinct().toLocalIterator())
    counted = stored(term_counts(docs, terms), "term-counts")
    rarest = Window.partitionBy("digest").orderBy("n", "offset")
    ranked = (
        placed.join(counted, "term")
        .withColumn("found", F.count("*").over(Window.partitionBy("digest")))
        .where("found = size")  # a window with a word that no document holds occurs nowhere
        .withColumn("number", F.row_number().over(rarest))
        .where(F.col("number") <= anchors)
        .select("digest", "term", "offset", "number")
    )
    ranked = stored(ranked, "anchors")
    wanted = frozenset(bytes(r[0]) for r in ranked.select("term").distinct().toLocalIterator())
    index = positional_index(docs, wanted)
    found = _shifted(index, ranked, 1)
    for number in range(2, anchors + 1):
        # a window of one word has one anchor and passes
        having = ranked.where(F.col("number") == number).select("digest", F.lit(True).alias("more"))
        marked = found.join(having, "digest", "left")
        matched = marked.where("more").drop("more").join(_shifted(index, ranked, number).distinct(), ["doc_id", "digest", "start"], "left_semi")
        found = matched.unionByName(marked.where("more IS NULL").drop("more"))
    return found


def proximity_matches(index: DataFrame, queries: DataFrame, width: int) -> DataFrame:
    """(query_id, doc_id, start, stop): the shortest, then first, stretch of at most ``width`` words with all terms of a query.

    ``queries`` has (query_id, terms array<binary>), ``index`` the postings of those terms. Only
    the postings of one document and query meet in a task.
    """
    wanted = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term"), F.size(F.array_distinct("terms")).alias("n"))
    lists = (
        index.join(wanted, "term")
        .groupBy("query_id", "doc_id")
        .agg(F.first("n").alias("n"), F.collect_list("positions").alias("lists"))
        .where(F.size("lists") == F.col("n"))
    )
    schema = StructType([lists.schema["query_id"], lists.schema["doc_id"], StructField("start", IntegerType()), StructField("stop", IntegerType())])
    return map_batches(lists.drop("n"), _nearest(width), schema)


def _nearest(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, stops = [], [], []
            for row, lists in enumerate(batch.column("lists").to_pylist()):
                events = sorted((at, term) for term, positions in enumerate(lists) for at in positions)
                held: Counter = Counter()
                best, low = None, 0
                for at, term in events:
                    held[term] += 1
                    while held[events[low][1]] > 1:
                        held[events[low][1]] -= 1
                        low += 1
                    size = at - events[low][0] + 1
                    if len(held) == len(lists) and (best is None or size < best[0]):
                        best = (size, events[low][0])
                if best and best[0] <= width:
                    rows.append(row)
                    starts.append(best[1])
                    stops.append(best[1] + best[0])
            picked = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [picked.column("query_id"), picked.column("doc_id"), pa.array(starts, pa.int32()), pa.array(stops, pa.int32())],
                names=["query_id", "doc_id", "start", "stop"],
            )

    return run


_ADDED = [
    StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("n_items", LongType()),
    StructField("items_sha256", StringType()), StructField("contaminated", BooleanType()), StructField("hit_spans", ArrayType(ArrayType(IntegerType()))),
]


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {f.name: [] for f in _ADDED}
        for text, candidates in zip(batch.column("_text").to_pylist(), batch.column("_candidates").to_pylist()):
            words = item_words(text)
            hit = bytearray(len(words))
            items: set[str] = set()
            for c in candidates or ():
                part = words[c["start"] : c["start"] + c["size"]]
                if len(part) == c["size"] and window_digest(part) == c["digest"]:
                    hit[c["start"] : c["start"] + c["size"]] = b"\x01" * c["size"]
                    items.update(c["items"])
            spans, at = [], hit.find(1)
            while at >= 0:
                stop = hit.find(0, at)
                stop = len(hit) if stop < 0 else stop
                spans.append([at, stop])
                at = hit.find(1, stop)
            n_hit = hit.count(1)
            out["n_words"].append(len(words))
            out["n_hit"].append(n_hit)
            out["n_items"].append(len(items))
            out["items_sha256"].append(hashlib.sha256(",".join(sorted(items)).encode("utf-8")).hexdigest())
            out["contaminated"].append(n_hit > 0 and 20 * n_hit >= len(words))
            out["hit_spans"].append(spans)
        names = [n for n in batch.schema.names if n not in ("_text", "_candidates")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(n) for n in names] + [pa.array(v, k) for v, k in zip(out.values(), kinds)], names=names + list(out)
        )


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, anchors: int = ANCHORS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated`` and ``hit_spans``.

    A word is hit if it lies in any occurrence of a benchmark window; a document is
    contaminated if at least a twentieth of its words, and one, are hit. ``hit_spans`` are the
    [start, stop) word ranges. Null and empty texts have no words; items without words have
    no window; items with a null id hit words but are not counted or listed. Repeated item_ids
    count once and rows of ``docs`` that repeat a doc_id, or have none, are each judged on their own text.
    Other columns pass through, and those with the new names are replaced. Windows are
    looked for in blocks of about ``block_terms`` words, so that what goes to the workers is bounded.
    """
    docs = docs.drop(*[f.name for f in _ADDED], "_text", "_candidates", "_doc")
    windows = stored(benchmark_windows(items, size), "windows")
    phrases = windows.groupBy("digest").agg(F.first("terms").alias("terms"), F.collect_set("item_id").alias("items"))
    phrases = stored(phrases, "phrases")
    words = phrases.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(words / block_terms))
    found = None
    for block in range(blocks):
        own = phrases.where(F.pmod(F.xxhash64("digest"), F.lit(blocks)) == block)
        part = phrase_candidates(docs, own.select("digest", "terms"), anchors)
        found = part if found is None else found.unionByName(part)
    per_doc = (
        found.join(phrases.select("digest", F.size("terms").alias("size"), "items"), "digest")
        .groupBy(F.col("doc_id").alias("_doc"))
        .agg(F.collect_set(F.struct("start", "size", "digest", "items")).alias("_candidates"))
    )
    joined = (
        docs.join(per_doc, _key() == F.col("_doc"), "left").drop("_doc").withColumn("_text", F.col("text").cast("binary"))
    )
    schema = StructType([*docs.schema.fields, *_ADDED])
    return map_batches(joined, _judged, schema)
