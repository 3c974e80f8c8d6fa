"""Log-bilinear language model with noise-contrastive estimation, and a unigram base.

Counts come from all training texts by Spark jobs. The ``WORDS`` most frequent tokens are
classes of their own, all others share one class in which a token is drawn by its count.
A class follows the one before it with a score that is bilinear in their vectors plus a
bias. Noise-contrastive estimation fits the vectors on the counts of all observed pairs of classes:
in turns the vectors of one side are fitted in tasks while those of the other stand, as
then every class is a problem of its own. The noise's expectation is taken over classes drawn evenly by
frequency. At last tasks multiply the vectors of each class by those of all classes, in batches, for
the logarithm of its sum of scores, so log-probabilities are normalised.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructField, StructType

from salescope.llm.common import map_batches, stored

END = b"\n"  # no word holds white space, so this stands for the end of a text
SMOOTHING = 0.1
WORDS = 200_000  # classes besides the shared one
HEAD = 200_000  # tokens whose counts go to every task; the counts of all others are joined
PART_BYTES = 12_000_000  # of texts for each part of the token counts, so their number grows with the table
HELD_TOKENS = 250_000  # distinct tokens that a counting task holds at a time
SCORED_ROWS = 500  # texts whose rare tokens a task holds
HELD_PAIRS = 2_000_000  # that a task adds to its table at a time
PART_PAIRS = 1_000_000  # or so, that are summed or sorted at a time
PACKS = "part int, size long, keys binary, n binary"  # keys and n are int64, keys as differences, both compressed
PACKED = pa.schema([("part", pa.int32()), ("size", pa.int64()), ("keys", pa.binary()), ("n", pa.binary())])
FITTED_PAIRS = 150_000  # that a task fits at a time, or those of one class
FITTED_TOGETHER, FITTED_PADDED = 2_000, 100_000  # vectors and pairs in one batch of matrices, or one vector
SUMMED = 2_000  # classes whose sums one task takes
VECTOR, NOISE, DRAWN, ROUNDS, STEPS, RATE, RIDGE = 24, 5.0, 500, 2, 12, 0.2, 1.0


def tokens(text: bytes | None) -> list[bytes]:
    """Words between white space (space, 0x09 to 0x0D), A-Z lower-cased, and one end."""
    words = text.lower().split() if text else []
    words.append(END)
    return words


def _token_counts(parts: int):
    """Packs of distinct tokens by their part, each with its count in some texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            part = np.fromiter(map(zlib.crc32, counts), np.uint32, len(counts)) % np.uint32(parts)
            order, ends = np.argsort(part, kind="stable"), np.cumsum(np.bincount(part, minlength=parts))
            words, n = pa.array(list(counts), pa.binary()).take(pa.array(order)), np.fromiter(counts.values(), np.int64, len(counts))[order]
            counts.clear()
            starts = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1)
            data = memoryview(words.buffers()[2] or b"")
            rows = [(k, i, j) for k, (i, j) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())) if i < j]
            for at in range(0, len(rows), 100):
                some = rows[at : at + 100]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k for k, _, _ in some], pa.int32()), pa.array([np.diff(starts[i : j + 1]).tobytes() for _, i, j in some], pa.binary()),
                        pa.array([data[starts[i] : starts[j]].tobytes() for _, i, j in some], pa.binary()), pa.array([n[i:j].tobytes() for _, i, j in some], pa.binary()),
                    ],
                    names=["part", "sizes", "words", "n"],
                )

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(tokens(text))
                if len(counts) > HELD_TOKENS:
                    yield from out()
        if counts:
            yield from out()

    return run


def _added(packs: pa.Table) -> pa.Table:
    """(token, n) of a part's packs."""
    sizes = np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for x in packs.column("sizes")])
    ends = np.cumsum(sizes, dtype=np.int64)
    words = b"".join(x.as_py() for x in packs.column("words"))
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.append(0, ends)), pa.py_buffer(words)])
    n = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in packs.column("n")])
    summed = pa.table({"token": found, "n": n}).group_by("token").aggregate([("n", "sum")])
    return pa.table({"token": summed.column("token").cast(pa.binary()), "n": summed.column("n_sum")})


def token_counts(texts: DataFrame) -> DataFrame:
    """Stored (token, n) over all rows of ``texts`` (text as bytes).

    A task's counts go in packs to parts by the tokens' checksum, a pack being one row for Spark, and are added there.
    """
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    packs = map_batches(texts.select("text"), _token_counts(1 + size // PART_BYTES), "part int, sizes binary, words binary, n binary")
    return stored(packs.groupBy("part").applyInArrow(_added, "token binary, n long"), "token-counts")


def _frequent(counts: DataFrame, most: int) -> dict[bytes, int]:
    """The most frequent tokens and their counts, as many whole steps of frequency as ``most`` tokens hold.

    A step is a sixteenth of a doubling, so at most 1,000 rows tell where to cut; no task orders tokens.
    """
    step = F.floor(16 * F.log2("n"))
    sizes = {r[0]: r[1] for r in counts.groupBy(step.alias("step")).count().collect()}
    least, held = None, 0
    for at in sorted(sizes, reverse=True):
        held += sizes[at]
        if held > most:
            break
        least = at
    if least is None:
        return {}
    rows = counts.where(step >= least).toArrow()
    return dict(sorted(zip(rows.column("token").to_pylist(), rows.column("n").to_pylist()), key=lambda x: (-x[1], x[0])))


def _mixed(numbers: np.ndarray, parts: int) -> np.ndarray:
    """The part of each number; neighbours and multiples are spread."""
    return ((numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(parts)


def _small(numbers: np.ndarray) -> bytes:
    """Compressed, so that rows of packs take little of the memory that Spark and Arrow hold for them."""
    return pa.compress(numbers.tobytes(), "zstd", asbytes=True)


def _whole(packed: bytes, size: int, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, size * np.dtype(kind).itemsize, "zstd", asbytes=True), kind)


def _packs(keys: np.ndarray, n: np.ndarray, part: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(part, size, keys, n): what goes to one part is one row; ``keys`` are ascending and packed as their differences."""
    order = np.argsort(part.astype(np.uint16) if len(part) and part.max() < 1 << 16 else part, kind="stable")
    part, keys, n = part[order], keys[order], n[order].astype(np.int64)
    starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.empty(0, int)
    ends = np.append(starts[1:], len(part))
    for at in range(0, len(starts), 100):
        rows = list(zip(starts[at : at + 100].tolist(), ends[at : at + 100].tolist()))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([int(part[i]) for i, _ in rows], pa.int32()), pa.array([k - i for i, k in rows], pa.int64()),
                pa.array([_small(np.diff(keys[i:k], prepend=0)) for i, k in rows], pa.binary()), pa.array([_small(n[i:k]) for i, k in rows], pa.binary()),
            ],
            names=PACKED.names,
        )


def _opened(packs: pa.Table | pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and counts of each pack."""
    for size, keys, n in zip(*(packs.column(name) for name in ("size", "keys", "n"))):
        yield np.cumsum(_whole(keys.as_buffer(), size.as_py())), _whole(n.as_buffer(), size.as_py())


def _unpacked(packs: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order and their sums, of all packs."""
    found, times = (np.concatenate(x) for x in zip(*_opened(packs)))
    order = np.argsort(found, kind="stable")
    found, times = found[order], times[order]
    starts = np.flatnonzero(np.diff(found, prepend=-1))
    return found[starts], np.add.reduceat(times, starts)


def _summed(packs: pa.Table) -> pa.Table:
    """One pack of the pairs of a part, each with its count over all tasks."""
    pairs, n = _unpacked(packs)
    return pa.Table.from_batches(_packs(pairs, n, np.zeros(len(pairs), np.int64)), PACKED)


def _dealt(width: int, parts: int, turned: bool):
    """Packs of pairs anew by the class of one side, whose pairs all go to one part; ``turned``: by the class after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pairs, times in _opened(batch):
                if turned:
                    pairs = pairs % width * width + pairs // width
                    order = np.argsort(pairs)
                    pairs, times = pairs[order], times[order]
                yield from _packs(pairs, times, _mixed(pairs // width, parts))

    return run


def _gathered(width: int):
    """Of a part's packs: rows of some whole classes with their totals, and their pairs in order of the class."""

    def run(packs: pa.Table) -> pa.Table:
        pairs, n = _unpacked(packs)
        own = pairs // width
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        totals, ends = np.add.reduceat(n, starts), np.append(starts[1:], len(own))
        rows, first = [], 0
        while first < len(starts):
            last = max(first + 1, int(np.searchsorted(ends, starts[first] + FITTED_PAIRS, side="right")))
            at = slice(int(starts[first]), int(ends[last - 1]))
            ids = own[starts[first:last]].astype(np.int32)
            begun = (starts[first:last] - starts[first]).astype(np.int32)
            rows.append((at.stop - at.start, ids.tobytes(), totals[first:last].tobytes(), begun.tobytes(), _small((pairs[at] % width).astype(np.int32)), _small(n[at])))
            first = last
        sizes, *others = zip(*rows)
        return pa.Table.from_arrays([pa.array(sizes, pa.int64()), *(pa.array(c, pa.binary()) for c in others)], names=["size", "ids", "totals", "starts", "to", "n"])

    return run


def _pair_counts(classes: dict[bytes, int], parts: int):
    """Packs of pairs by their part; a pair is the class before times the number of classes, plus the class."""
    other, width = len(classes), len(classes) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            pairs, n = np.unique(np.concatenate(held), return_counts=True)
            yield from _packs(pairs, n, _mixed(pairs, parts))

        for batch in batches:
            for text in batch.column(0).to_pylist():
                row = _classes(tokens(text), classes, other)
                held.append(row[:-1] * width + row[1:])
                size += len(row)
                if size > HELD_PAIRS:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()

    return run


def _packed(parts: int):
    """Packs of rows (pair, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, n = (batch.column(i).to_numpy() for i in range(2))
            order = np.argsort(pairs)
            yield from _packs(pairs[order], n[order], _mixed(pairs[order], parts))

    return run


def _classes(words: list[bytes], classes: dict[bytes, int], other: int) -> np.ndarray:
    """Classes of a text's tokens, led by the end that precedes every text."""
    out = np.empty(len(words) + 1, np.int64)
    out[0] = classes.get(END, other)
    out[1:] = list(map(classes.get, words, repeat(other)))
    return out


def _drawn(counts: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """``DRAWN`` classes in proportion to their counts, at even distances."""
    ends = np.cumsum(counts, dtype=float)
    return np.minimum(np.searchsorted(ends, (np.arange(DRAWN) + random.random()) * ends[-1] / DRAWN, side="right"), len(counts) - 1)


def _improved(starts: np.ndarray, to: np.ndarray, n: np.ndarray, other: np.ndarray, drawn: np.ndarray, biased: bool) -> np.ndarray:
    """Vectors by some steps from zero; the pairs of the i-th begin at starts[i] and lead to the classes ``to``, n times.

    The loss of a pair is its count times ``-log s(d)`` plus its noise count times ``-log s(-d)``, where d
    is the score less the logarithm of the noise's rate. A vector's last component is the bias less that
    logarithm, or one on the side that has none and keeps it.
    """
    out = np.empty((len(starts), VECTOR + 1), np.float32)
    sizes = np.diff(starts, append=len(to))
    noise = other[drawn]
    weight = (NOISE / DRAWN * np.add.reduceat(n, starts)).astype(np.float32)[:, None]
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        # vectors with about as many pairs each make a batch of matrices, filled up with pairs that count nothing
        least = int(sizes[order[at]])
        most = max(1, min(FITTED_TOGETHER, FITTED_PADDED // (least + least // 2)))
        end = min(at + most, int(np.searchsorted(sizes[order], least + least // 2, side="right")))
        ids = order[at:end]
        place = np.arange(int(sizes[ids[-1]]))
        filled = place < sizes[ids][:, None]
        pairs = np.where(filled, starts[ids][:, None] + place, 0)
        out[ids] = _steps(other[to[pairs]], np.where(filled, n[pairs], 0).astype(np.float32), noise, weight[ids], biased)
        at = end
    return out


def _steps(x: np.ndarray, n: np.ndarray, noise: np.ndarray, weight: np.ndarray, biased: bool) -> np.ndarray:
    """Vectors from zero; those of each one's pairs are a matrix of ``x`` and come ``n`` times."""
    own = np.zeros((len(x), VECTOR + 1), np.float32)
    own[:, VECTOR] = -math.log(NOISE) if biased else 1
    first, second = np.zeros_like(own), np.zeros_like(own)
    away = np.ascontiguousarray(-noise.T)
    push = np.empty((len(x), len(noise)), np.float32)
    for step in range(1, STEPS + 1):
        pull = _share(n, np.matmul(x, own[:, :, None])[:, :, 0])
        g = _share(weight, np.matmul(own, away, out=push)) @ noise
        g -= np.matmul(pull[:, None, :], x)[:, 0]
        g[:, :VECTOR] += RIDGE * own[:, :VECTOR]
        if not biased:
            g[:, VECTOR] = 0
        first = 0.8 * first + 0.2 * g
        second = 0.9 * second + 0.1 * g * g
        speed = RATE * (1 - step / (STEPS + 1))
        own -= speed * (first / (1 - 0.8**step)) / (np.sqrt(second / (1 - 0.9**step)) + 1e-10)
    return own


def _share(n: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """``n / (1 + exp(odds))`` in the place of ``odds``."""
    np.minimum(odds, 30, out=odds)
    np.exp(odds, out=odds)
    odds += 1
    return np.divide(n, odds, out=odds)


def _fitted(shared: Broadcast, drawn: np.ndarray, biased: bool):
    """Of rows that hold whole classes of this side with their pairs: the new vectors of the classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other = shared.value.astype(np.float32)
        for batch in batches:
            for i in range(batch.num_rows):
                size, starts = batch.column("size")[i].as_py(), np.frombuffer(batch.column("starts")[i].as_buffer(), np.int32)
                to, n = (_whole(batch.column(name)[i].as_buffer(), size, kind) for name, kind in (("to", np.int32), ("n", np.int64)))
                vectors = _improved(starts, to, n, other, drawn, biased)
                yield pa.RecordBatch.from_arrays([batch.column("ids").slice(i, 1), pa.array([vectors.astype(np.float16).tobytes()], pa.binary())], names=["ids", "vectors"])

    return run


def _start(width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.random.Generator]:
    """Vectors of both sides, and the rest of the draw; scores begin near the unigram distribution."""
    random = np.random.default_rng(seed)
    rows, columns = (random.standard_normal((width, VECTOR + 1), np.float32) * np.float32(0.3) for _ in range(2))
    rows[:, VECTOR], columns[:, VECTOR] = 1, -math.log(NOISE)
    return rows, columns, random


def _with_rate(columns: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Vectors whose last component is the whole bias."""
    columns = columns.copy()
    columns[:, VECTOR] += np.log(NOISE * (counts + SMOOTHING) / (counts.sum() + SMOOTHING * len(counts)))
    return columns


def log_sums(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Logarithms of the sums of all scores, for each of ``rows``."""
    out = np.empty(len(rows))
    for at in range(0, len(rows), 64):
        own = rows[at : at + 64]
        with np.errstate(over="ignore", divide="ignore"):
            total = np.zeros(len(own))
            for k in range(0, len(columns), 512):
                scores = own @ columns[k : k + 512].T
                total += np.exp(scores, out=scores).sum(axis=1)
            out[at : at + 64] = np.log(total)
        for i in np.flatnonzero(~np.isfinite(total) | (total < 1e-20)):  # beyond what a float holds
            scores = (columns @ own[i]).astype(np.float64)
            out[at + i] = scores.max() + np.log(np.exp(scores - scores.max()).sum())
    return out


def fit_vectors(pairs: np.ndarray, seed: int = 0) -> np.ndarray:
    """Normalised log-probabilities [before, class] from a small table of the counts of pairs."""
    rows, columns, random = _start(len(pairs), seed)
    for _ in range(ROUNDS):
        for own, other, table, biased in ((rows, columns, pairs, False), (columns, rows, pairs.T, True)):
            at, to = np.nonzero(table)
            ids = np.unique(at)
            if len(ids):
                drawn = _drawn(table.sum(axis=0), random)
                own[ids] = _improved(np.flatnonzero(np.diff(at, prepend=-1)), to, table[at, to], other, drawn, biased)
    columns = _with_rate(columns, pairs.sum(axis=0))
    return (rows @ columns.T - log_sums(rows, columns)[:, None]).astype(np.float32)


def fit_pairs(pairs: DataFrame, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors before, vectors after and logarithms of sums from all (pair, n), fitted in tasks.

    Vectors are sent and kept as half floats, and the sums are those of the vectors so rounded.
    """
    parts = 1 + pairs.count() // PART_PAIRS
    return fit_packs(map_batches(pairs, _packed(parts), PACKS), width, seed)


def fit_packs(packs: DataFrame, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same from packs of pairs; a pair may be in several, which must then be of one part.

    Pairs are summed by part, dealt by the class of either side and sorted in numpy, a pack being one row for Spark.
    """
    rows, columns, random = _start(width, seed)
    context = packs.sparkSession.sparkContext
    summed = stored(packs.groupBy("part").applyInArrow(_summed, PACKS), "pairs")
    parts = 1 + (summed.agg(F.sum("size")).first()[0] or 0) // PART_PAIRS
    kinds = "size long, ids binary, totals binary, starts binary, to binary, n binary"
    sides = [
        stored(map_batches(summed, _dealt(width, parts, turned), PACKS).groupBy("part").applyInArrow(_gathered(width), kinds), name)
        for turned, name in ((False, "pairs-before"), (True, "pairs-after"))
    ]
    counts = [np.zeros(width) for _ in sides]
    for side, own in zip(sides, counts):
        for ids, totals in zip(*side.select("ids", "totals").toArrow().to_pydict().values()):
            own[np.frombuffer(ids, np.int32)] = np.frombuffer(totals, np.int64)
    if counts[0].sum():
        for _ in range(ROUNDS):
            for at, (own, other) in enumerate(((rows, columns), (columns, rows))):
                shared = context.broadcast(other.astype(np.float16))
                run = _fitted(shared, _drawn(counts[1 - at], random), at == 1)
                for ids, vectors in zip(*map_batches(sides[at], run, "ids binary, vectors binary").toArrow().to_pydict().values()):
                    own[np.frombuffer(ids, np.int32)] = np.frombuffer(vectors, np.float16).reshape(-1, VECTOR + 1)
                shared.destroy()
    rows, columns = rows.astype(np.float16), _with_rate(columns, counts[1]).astype(np.float16)
    shared = context.broadcast((rows, columns))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, after = shared.value[0], shared.value[1].astype(np.float32)
        for batch in batches:
            own = before[batch.column(0).to_numpy()].astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(log_sums(own, after))], names=["id", "log_sum"])

    out = np.empty(width)
    found = map_batches(packs.sparkSession.range(0, width, 1, -(-width // SUMMED)), sums, "id long, log_sum double").toArrow()
    out[found.column("id").to_numpy()] = found.column("log_sum").to_numpy()
    shared.destroy()
    return rows, columns, out


def _scored(head: dict[bytes, int], shared: int, model: tuple[np.ndarray, np.ndarray, np.ndarray], base: tuple[float, float], other: float):
    """shared: the last class; base: logarithm's denominator terms; other: tokens of training that share the last class."""
    rows, columns, sums = model
    added = [("n_tokens", pa.int64()), ("_head_known", pa.int64()), ("_head_base", pa.float64()), ("_head_score", pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # tokens by their place in the head, of which the first are the classes; the last place is that of all others
        known = np.fromiter(head.values(), float, len(head))
        logs = np.append(np.log10((known + SMOOTHING) / base[0]), 0.0)
        in_class = np.append(np.log10(known / other), 0.0)
        in_class[:shared] = 0
        places = dict(zip(head, range(len(head))))
        for batch in batches:
            for at in range(0, batch.num_rows, SCORED_ROWS):
                yield scored(batch.slice(at, SCORED_ROWS), places, logs, in_class)

    def bilinear(row: np.ndarray) -> float:
        """Logarithm to 10 of the probability of all classes after the first."""
        total = 0.0
        for at in range(0, len(row) - 1, 2_000):  # so that the vectors stay in the cache
            before, after = row[at : at + 2_000], row[at + 1 : at + 2_001]
            before = before[: len(after)]
            scores = rows.take(before, axis=0).astype(np.float32)
            scores *= columns.take(after, axis=0).astype(np.float32)
            total += scores.sum(axis=1).sum(dtype=np.float64) - sums.take(before).sum()
        return total / math.log(10)

    def scored(batch: pa.RecordBatch, places: dict[bytes, int], logs: np.ndarray, in_class: np.ndarray) -> pa.RecordBatch:
        out: dict[str, list] = {n: [] for n, _ in added}
        tail_words: list[bytes] = []
        tail_counts: list[int] = []
        ends = [0]
        for text in batch.column("_text").to_pylist():
            words = tokens(text)
            row = _classes(words, places, len(head))
            own = row[1:]
            rare = np.flatnonzero(own == len(head))
            if len(rare):
                counts = Counter(map(words.__getitem__, rare.tolist()))
                tail_words += counts.keys()
                tail_counts += counts.values()
            out["n_tokens"].append(len(words))
            out["_head_known"].append(len(words) - len(rare))
            out["_head_base"].append(float(logs[own].sum()))
            out["_head_score"].append(float(in_class[own].sum()) + bilinear(np.minimum(row, shared)))
            ends.append(len(tail_words))
        pairs = pa.StructArray.from_arrays([pa.array(tail_words, pa.binary()), pa.array(tail_counts, pa.int64())], names=["token", "n"])
        names = [n for n in batch.schema.names if n != "_text"]
        arrays = [batch.column(n) for n in names] + [pa.array(out[n], t) for n, t in added] + [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)]
        return pa.RecordBatch.from_arrays(arrays, names=names + [n for n, _ in added] + ["_tail"])

    return run


def score_texts(docs: DataFrame, training: Column) -> DataFrame:
    """``docs`` without ``text`` but with n_tokens, n_known, train_tokens, base_score and score.

    The model learns from the rows where ``training`` is true, all of them and whole. Tokens are the
    words between ASCII white space, A-Z lower-cased, and one end for each text. ``base_score`` is the unigram
    log10 probability with 0.1 added to every count and to one unknown token; ``score`` is the
    log-bilinear model's. Its unknown tokens share, within the class of rare ones, the mass that tokens seen
    once suggest. A null text is empty: one token, the end. Without training rows every token is
    unknown and both scores rest on the smoothing alone. Repeated rows are scored each; other
    columns pass through and columns with the new names are replaced.
    """
    docs = docs.drop("n_tokens", "n_known", "train_tokens", "base_score", "score", "_text", "_tail", "_row")
    whole = F.col("text").cast("binary")
    learnt = docs.where(training).select(whole.alias("text"))
    counts = token_counts(learnt)
    head = _frequent(counts, HEAD)
    classes = {w: i for i, w in enumerate(list(head)[:WORDS])}
    n_train, types, once = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum((F.col("n") == 1).cast("long")), F.lit(0))
    ).first()
    shared = n_train - sum(head[w] for w in classes)
    # Within the shared class: unknown tokens get the share of those seen once, known ones the rest by their counts.
    unknown = (once + 1) / (shared + once + 2)
    class_total = shared / (1 - unknown) if shared else 1.0
    model = fit_packs(map_batches(learnt, _pair_counts(classes, 1 + n_train // PART_PAIRS), PACKS), len(classes) + 1)
    base_total = n_train + SMOOTHING * (types + 1)
    added = [StructField("n_tokens", LongType()), StructField("_head_known", LongType()), StructField("_head_base", DoubleType()), StructField("_head_score", DoubleType())]
    tail = StructField("_tail", ArrayType(StructType([StructField("token", BinaryType()), StructField("n", LongType())])))
    kept = docs.drop("text")
    schema = StructType([*kept.schema.fields, *added, tail])
    scored = map_batches(
        docs.withColumn("_text", whole).drop("text"), _scored(head, len(classes), model, (base_total, 0.0), class_total), schema
    )
    scored = stored(scored.withColumn("_row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("_row", F.explode("_tail").alias("t")).select("_row", F.col("t.token").alias("token"), F.col("t.n").alias("times"))
    count = F.coalesce(F.col("n"), F.lit(0))
    tails = (
        rare.join(counts, "token", "left")
        .select(
            "_row", "times", (count > 0).alias("known"), F.log10((count + SMOOTHING) / F.lit(float(base_total))).alias("base"),
            F.when(count > 0, F.log10(count / F.lit(float(class_total)))).otherwise(F.lit(math.log10(unknown))).alias("own"),
        )
        .groupBy("_row")
        .agg(
            F.sum(F.when(F.col("known"), F.col("times")).otherwise(0)).alias("_known"),
            F.sum(F.col("times") * F.col("base")).alias("_base"), F.sum(F.col("times") * F.col("own")).alias("_own"),
        )
    )
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    return scored.drop("_tail").join(tails, "_row", "left").select(
        *[F.col(f"`{f.name}`") for f in kept.schema.fields],
        "n_tokens",
        (F.col("_head_known") + zero("_known")).alias("n_known"),
        F.lit(int(n_train)).cast("long").alias("train_tokens"),
        (F.col("_head_base") + zero("_base")).alias("base_score"),
        (F.col("_head_score") + zero("_own")).alias("score"),
    )
