"""Exact top-k inner-product search by block-at-a-time pruning.

Rows are packed into blocks of consecutive rows. A block holds its vectors (the forward
index) and the largest and smallest value of each term, that is, of each component. The sum over terms of the
larger of ``q * max`` and ``q * min`` bounds every score in a block. For each query the
blocks are taken by falling bound and scored until the next bound lies below the
query's k-th score; a block that could still tie is scored.

Queries are a stated share of the rows. They are taken in blocks of bounded size, each of which
is sent to all tasks and meets the whole index once; every task returns k rows a query
at most, and those are ranked after one shuffle by query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from salescope.llm.common import map_batches, stored

BLOCK_ROWS = 64
QUERY_ROWS = 8_192  # queries in a block; with 64 components 4 MB
GROUP_ROWS = 512  # queries pruned together in a task

_BLOCKS = pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("rows", pa.binary()), ("high", pa.binary()), ("low", pa.binary())])


def usable(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, terms): components as floor(scale * x); rows null, empty, or holding null or non-finite components left out."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    # beyond 2**45 the 64-bit sum could overflow
    small = F.forall(x, lambda v: F.abs(v.cast("double") * scale) < F.lit(float(2**45)))
    rows = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(F.size(x) > 0).where(finite)
    terms = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    checked = F.when(small, terms).otherwise(F.raise_error(F.lit("components beyond 2**45 / scale give no 64-bit scores")))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), checked.alias("terms"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of BLOCK_ROWS vectors of equal length."""
    for batch in batches:
        ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
        lists = batch.column("terms")
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        starts = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
        out = {name: [] for name in _BLOCKS.names}
        for dim in np.unique(sizes):
            rows = np.flatnonzero(sizes == dim)
            for at in range(0, len(rows), BLOCK_ROWS):
                own = rows[at : at + BLOCK_ROWS]
                matrix = flat[starts[own][:, None] + np.arange(dim)[None, :]].astype("<i8")
                out["dim"].append(int(dim))
                out["ids"].append(ids[own].astype("<i8").tobytes())
                out["rows"].append(matrix.tobytes())
                out["high"].append(matrix.max(axis=0).tobytes())
                out["low"].append(matrix.min(axis=0).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in _BLOCKS], schema=_BLOCKS)


def block_index(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """The stored index: a row for each block of rows as the table holds them."""
    packed = map_batches(usable(vectors, scale), _pack, "dim int, ids binary, rows binary, high binary, low binary")
    return stored(packed, "vector-blocks")


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores of each row, smaller ids first among equals; sorted."""
    return np.lexsort((ids, -scores), axis=-1)[:, :k]


_NONE = -np.iinfo(np.int64).max  # so that its negative exists


def search_blocks(queries: np.ndarray, query_ids: np.ndarray, blocks: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best k (scores, ids) of each query in ``blocks`` of (ids, rows, high, low), and how many blocks were scored.

    Missing places have the least 64-bit score. A row with the query's own id is passed over.
    """
    exact = float(np.abs(queries).max(initial=1)) * max(float(np.abs(b[1]).max()) for b in blocks) * queries.shape[1] < 2**53
    kind = np.float64 if exact else np.int64  # both exact; matrix products of doubles are faster
    q = queries.astype(kind)
    high, low = (np.stack([b[n] for b in blocks]).astype(kind) for n in (2, 3))
    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    order = np.argsort(-bound, axis=1, kind="stable")
    scores = np.full((len(q), k), _NONE, np.int64)
    ids = np.full((len(q), k), np.iinfo(np.int64).max, np.int64)
    scored = 0
    active = np.arange(len(q))
    for step in range(len(blocks)):
        nxt = order[active, step]
        still = bound[active, nxt] >= scores[active, -1]
        active, nxt = active[still], nxt[still]
        if not len(active):
            break
        scored += len(active)
        for b in np.unique(nxt):
            mine = active[nxt == b]
            got = (q[mine] @ blocks[b][1].T.astype(kind)).astype(np.int64)
            own = np.broadcast_to(blocks[b][0], got.shape)
            got = np.where(own == query_ids[mine][:, None], _NONE, got)
            both, names = np.hstack([scores[mine], got]), np.hstack([ids[mine], own])
            names = np.where(both == _NONE, np.iinfo(np.int64).max, names)
            # most rows of a block stay below the k-th score: sort only what can enter
            places = _best(both, names, k)
            scores[mine] = np.take_along_axis(both, places, 1)
            ids[mine] = np.take_along_axis(names, places, 1)
    return scores, ids, scored


def _searched(query_ids: np.ndarray, by_dim: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """by_dim: dim -> (numbers of the queries, their vectors)."""
    schema = pa.schema([("number", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {d: (np.full((len(n), k), _NONE, np.int64), np.full((len(n), k), np.iinfo(np.int64).max, np.int64)) for d, (n, _) in by_dim.items()}
        for batch in batches:
            read = lambda row, name: np.frombuffer(row[name], "<i8")
            held: dict[int, list[tuple]] = {}
            for row in batch.to_pylist():
                if row["dim"] in by_dim:
                    block = (read(row, "ids"), read(row, "rows").reshape(-1, row["dim"]), read(row, "high"), read(row, "low"))
                    held.setdefault(row["dim"], []).append(block)
            for dim, blocks in held.items():
                numbers, vectors = by_dim[dim]
                for at in range(0, len(numbers), GROUP_ROWS):
                    part = slice(at, at + GROUP_ROWS)
                    got = search_blocks(vectors[part], query_ids[numbers[part]], blocks, k)
                    scores, ids = np.hstack([best[dim][0][part], got[0]]), np.hstack([best[dim][1][part], got[1]])
                    places = _best(scores, ids, k)
                    best[dim][0][part] = np.take_along_axis(scores, places, 1)
                    best[dim][1][part] = np.take_along_axis(ids, places, 1)
        for dim, (scores, ids) in best.items():
            found = scores != _NONE
            numbers = np.broadcast_to(by_dim[dim][0][:, None], scores.shape)[found]
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(ids[found]), pa.array(scores[found])], schema=schema)

    return run


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row whose vec_id ``every`` divides.

    Components x become floor(scale * x); the score is the integer inner product with the rows of the
    same length, the query's own id left out; ties go to the smaller vec_id. Rows whose vec_id or
    vector is null, whose vector is empty or holds null or non-finite components, take no
    part. Rows that repeat a vec_id are candidates each on their own, and queries each on
    their own, all with the same query_id. Other columns are not read. Components so large that a score
    would not fit 64 bits are an error.
    """
    index = block_index(vectors, scale)
    asked = stored(
        usable(vectors, scale).where(F.pmod("vec_id", F.lit(every)) == 0), "vector-queries"
    )
    blocks = max(1, -(-asked.count() // query_rows))
    found = None
    for block in range(blocks):
        # the caller's queries, a block at a time: at most about query_rows of them
        own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).select("vec_id", "terms").toArrow()
        ids = own.column("vec_id").to_numpy()
        lists = own.column("terms").to_pylist()
        sizes = np.array([len(x) for x in lists], dtype=np.int64)
        by_dim = {
            int(d): (np.flatnonzero(sizes == d).astype(np.int32), np.array([lists[i] for i in np.flatnonzero(sizes == d)], dtype=np.int64))
            for d in np.unique(sizes)
        }
        names = vectors.sparkSession.createDataFrame(
            pa.table({"number": pa.array(np.arange(len(ids)), pa.int32()), "query_id": pa.array(ids, pa.int64())})
        )
        part = map_batches(index, _searched(ids, by_dim, k), "number int, vec_id long, score long").join(F.broadcast(names), "number")
        part = part.withColumn("block", F.lit(block))
        found = part if found is None else found.unionByName(part)
    ranked = Window.partitionBy("block", "number").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
