"""Line dedup over levelled sorted runs of line hashes.

Line hashes are taken in batches of documents. A run is a table of hashes, bucketed and
sorted by hash; no hash lies in two runs. Each batch is merge-joined with the runs one
after another: hashes that none of them holds (the anti-join) become the batch's own
run at level 0, the others only add to their counts. As soon as a level has ``fanout``
runs, they are compacted into one run of the next level, so that a batch meets few runs.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from salescope.llm.common import map_batches, stored, without
from salescope.session import scratch_path

_HASHES = pa.schema([("doc_id", pa.int64()), ("key", pa.binary())])


def line_hash(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of a line's key, or None where the key is shorter than ``min_chars`` code points."""
    key = line.strip()  # of bytes: space and 0x09 to 0x0D
    if len(key) < min_chars or not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return hashlib.blake2b(key.lower(), digest_size=16).digest()


def _hashes(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, keys = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = {line_hash(line, min_chars) for line in text.split(b"\n")} - {None}
                docs += [doc] * len(own)
                keys += own
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(keys, pa.binary())], schema=_HASHES)

    return run


def line_hashes(docs: DataFrame, min_chars: int, batches: int) -> DataFrame:
    """(doc_id, key, batch): each document's distinct long lines, stored by batch."""
    hashed = map_batches(
        docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("text").cast("binary")),
        _hashes(min_chars), "doc_id long, key binary",
    ).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int"))
    path = scratch_path(docs.sparkSession, "line-hashes")
    hashed.write.partitionBy("batch").parquet(path)
    schema = StructType([*hashed.drop("batch").schema.fields, StructField("batch", IntegerType())])
    return docs.sparkSession.read.schema(schema).parquet(path)


def _save(df: DataFrame, split: bool, names: list[str]) -> DataFrame:
    """A table bucketed and sorted by key, so that a merge join with it moves none of its rows; its name joins ``names``."""
    spark = df.sparkSession
    name = f"line_run_{uuid.uuid4().hex}"
    names.append(name)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.write.bucketBy(buckets, "key").sortBy("key").option("path", scratch_path(spark, "line-run"))
    (writer.partitionBy("seen") if split else writer).saveAsTable(name)
    return spark.table(name)


def levelled_runs(hashes: DataFrame, batches: int, fanout: int) -> tuple[list[DataFrame], list[DataFrame], list[str]]:
    """The final runs (each key in one of them), the counts added by later batches, and the names of all tables made."""
    levels: list[list[DataFrame]] = [[]]
    added, names = [], []
    for number in range(batches):
        counted = (
            hashes.where(F.col("batch") == number)
            .groupBy("key")
            .agg(F.countDistinct("doc_id").alias("n_docs"), F.max("doc_id").alias("last_doc"))
            .withColumn("seen", F.lit(False))
        )
        for run in (r for level in levels for r in level):
            held = run.select("key", F.lit(True).alias("held"))
            counted = counted.join(held, "key", "left").withColumn("seen", F.col("seen") | F.col("held").isNotNull()).drop("held")
        table = _save(counted, True, names)
        levels[0].append(table.where("NOT seen").drop("seen"))
        added.append(table.where("seen").drop("seen"))
        for level in range(number + 1):
            if len(levels[level]) < fanout:
                break
            merged = levels[level][0]
            for run in levels[level][1:]:
                merged = merged.unionByName(run)
            if level + 1 == len(levels):
                levels.append([])
            levels[level + 1].append(_save(merged.repartition("key"), False, names))
            levels[level] = []
    return [r for level in levels for r in level], added, names


def repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 2) -> tuple[DataFrame, DataFrame]:
    """All line hashes, and (key, last_doc) of those found in at least ``min_docs`` documents."""
    hashes = line_hashes(docs, min_chars, batches)
    runs, added, names = levelled_runs(hashes, batches, fanout)
    counts = runs[0]
    for part in runs[1:] + added:
        counts = counts.unionByName(part)
    totals = counts.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))
    # stored, so that the join with a very frequent line has two shuffled sides, which Spark can split
    repeated = stored(totals.where(F.col("n_docs") >= min_docs).select("key", "last_doc"), "repeated-lines")
    for name in names:  # the catalog forgets the runs; their files lie in the shared folder
        docs.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    return hashes, repeated


def _rebuilt(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            texts, counts, drops = [], [], []
            for text, dropped in zip(batch.column("text").to_pylist(), batch.column("_dropped").to_pylist()):
                lines = (text or "").split("\n")
                kept = lines
                if dropped:
                    gone = set(dropped)
                    kept = [x for x in lines if line_hash(x.encode("utf-8"), min_chars) not in gone]
                texts.append(text if kept is lines else "\n".join(kept))
                counts.append(len(lines))
                drops.append(len(lines) - len(kept))
            columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names if n != "_dropped"]
            columns += [pa.array(counts, pa.int64()), pa.array(drops, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[n for n in names if n != "_dropped"] + ["n_lines", "n_dropped"])

    return run


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 2) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, plus ``n_lines`` (before) and ``n_dropped``.

    A line's key is the line without white space (space, 0x09 to 0x0D) at its ends, A-Z
    lower-cased. Keys of at least ``min_chars`` code points found in at least ``min_docs``
    distinct doc_ids lose all their lines except in the largest such doc_id. The
    rest is joined by line feeds. A null text stays null and counts as one empty line; an
    empty text is one empty line. Rows with a null doc_id take no part and stay as they are.
    Rows that repeat a doc_id count as one document and are treated alike. Other
    columns pass through; ``n_lines`` and ``n_dropped`` replace columns of these names.
    """
    docs = docs.drop("n_lines", "n_dropped", "_dropped")
    hashes, repeated = repeated_lines(docs, min_chars, min_docs, batches, fanout)
    dropped = (
        hashes.join(repeated, "key")
        .where(F.col("doc_id") != F.col("last_doc"))
        .groupBy(F.col("doc_id").alias("_doc"))
        .agg(F.collect_set("key").alias("_dropped"))
    )
    joined = docs.join(dropped, F.col("doc_id") == F.col("_doc"), "left").drop("_doc")
    schema = StructType([*without(joined.schema, "_dropped").fields, StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    return map_batches(joined, _rebuilt(min_chars), schema)
