"""Removal of repeated passages, located by Aho-Corasick automata.

1. Seeds: of every window of ``size`` words the least hash among its shorter word runs, its seed, is
   taken. Equal windows have equal seeds, so only seeds that recur can lie in recurring windows.
2. Confirmation: windows whose seed recurs meet under their seed and are compared; what
   comes back is which windows recur, once for each text that holds them.
3. Location: the stretches of recurring windows of a shard of documents are its recurring passages. Their
   words, cut into blocks of which every window holds at least one, are compiled into an automaton; all
   texts of the shard stream through it, and each match is extended word by word. That a window recurs in another shard
   rests on the hash of its seed (64 bits) and its own (48 bits).

Windows of a frequent seed are counted one by one, in part before they are shuffled, so that no task holds all its rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from salescope.llm.common import map_batches, stored, unused

WINDOW, SEED = 35, 14
SHARD_BYTES = 8 << 20  # text that shares an automaton
DIGIT_BITS = 6  # of a word's number that one character of an automaton's text stands for
HOT = 10_000  # texts that hold a seed from which on its windows are counted one by one
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def _runs(words: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of all runs of ``length`` words."""
    n = len(words) - length + 1
    out = np.full(n, length, np.uint64)
    for i in range(length):
        out = out * _A + words[i : i + n]
    return _mixed(out)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def seed_places(words: np.ndarray, size: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(seeds of all runs, for each window the place of its least seed, the last of equal ones)."""
    seeds = _runs(words, seed)
    width = size - seed + 1
    # least over a sliding stretch by doubling its length, ties to the right
    best, at, have = seeds, np.arange(len(seeds)), 1
    while have < width:
        step = min(have, width - have)
        left, right = best[: len(best) - step], best[step:]
        take = right <= left
        best, at = np.where(take, right, left), np.where(take, at[step:], at[: len(at) - step])
        have += step
    return seeds, at


def _rows(docs: DataFrame) -> DataFrame:
    """(doc, tag, text): two 64-bit hashes name a row by its doc_id and text, also where ids are null or repeated."""
    doc, tag = _name(docs)
    return docs.select(doc.alias("doc"), tag.alias("tag"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def _name(docs: DataFrame) -> tuple[Column, Column]:
    text, key = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit(" "))
    return F.xxhash64(text, key), F.xxhash64(F.lit(1), key, text)


def _seeds(size: int, seed: int):
    schema = pa.schema([("seed", pa.int64()), ("doc", pa.int64()), ("tag", pa.int64()), ("twice", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, counts, lengths, rows = [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                words = text.split()
                if len(words) < size:
                    continue
                seeds, places = seed_places(word_hashes(words), size, seed)
                own, times = np.unique(seeds[np.unique(places)], return_counts=True)
                found.append(own)
                counts.append(times > 1)
                lengths.append(len(own))
                rows.append(row)
            at = np.repeat(np.array(rows, np.int64), lengths)
            take = lambda name: batch.column(name).take(pa.array(at))
            flat = np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat), take("doc"), take("tag"), pa.array(np.concatenate(counts) if counts else np.empty(0, bool))], schema=schema
            )

    return run


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by seed those whose seed another row has too, or that hold it twice; holds one row."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            lead = carried
        else:
            lead = False
        seeds = batch.column("seed").to_numpy()
        same = seeds[1:] == seeds[:-1]
        kept = batch.column("twice").to_numpy(zero_copy_only=False).copy()
        kept[1:] |= same
        kept[:-1] |= same
        kept[0] |= lead
        # the last row waits for its successor
        held, carried = batch.slice(batch.num_rows - 1), bool(kept[-1])
        yield batch.slice(0, batch.num_rows - 1).filter(pa.array(kept[:-1])).select(["seed", "doc", "tag"])
    if held is not None:
        yield held.filter(pa.array([carried])).select(["seed", "doc", "tag"])


_WINDOWS = "seed long, windows binary, doc long, tag long, start int, twice boolean"


def _windows(size: int, seed: int, single: bool):
    """The windows of a text's wanted seeds, those of a seed's place together or each by itself, equal ones once."""
    schema = pa.schema(
        [("seed", pa.int64()), ("windows", pa.binary()), ("doc", pa.int64()), ("tag", pa.int64()), ("start", pa.int32()), ("twice", pa.bool_())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                yield rows(batch.slice(at, 500))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {n: [] for n in schema.names}
        for doc, tag, text, known in zip(*(batch.column(n).to_pylist() for n in ("doc", "tag", "text", "seeds"))):
            hashes = word_hashes(text.split())
            seeds, places = seed_places(hashes, size, seed)
            own = seeds[places].view(np.int64)
            wanted = np.isin(own, np.array(known, np.int64))
            if not wanted.any():
                continue
            full = _runs(hashes, size)
            packed = np.ascontiguousarray(full.view(np.uint8).reshape(-1, 8)[:, :6])
            cuts = np.arange(len(places)) if single else np.flatnonzero(np.diff(places, prepend=-1))
            seen: dict[tuple, int] = {}
            for begin, end in zip(cuts, np.append(cuts[1:], len(places))):
                if not wanted[begin]:
                    continue
                name, windows = int(own[begin]), packed[begin:end].tobytes()
                key = (name, windows)
                if key in seen:  # the automaton will find it again
                    out["twice"][seen[key]] = True
                    continue
                seen[key] = len(out["seed"])
                for column, value in zip(schema.names, (name, windows, doc, tag, int(begin), False)):
                    out[column].append(value)
        return pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return run


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (seed, windows): which of each row's windows another row has too, as bits.

    A seed's rows, less than ``HOT``, are held, those with the same windows only once.
    """
    schema = pa.schema([("doc", pa.int64()), ("tag", pa.int64()), ("start", pa.int32()), ("bits", pa.int32())])
    out: dict[str, list] = {n: [] for n in schema.names}

    def put(row: tuple, bits: int) -> None:
        for column, value in zip(schema.names, (*row, bits)):
            out[column].append(value)

    def close(variants: list) -> None:
        """variants: [windows, first row, does it recur as a whole?]"""
        owners: dict[bytes, list] = {}
        bits = [0] * len(variants)
        for v, (windows, _, whole) in enumerate(variants):
            for i in range(len(windows) // 6):
                owners.setdefault(windows[6 * i : 6 * i + 6], []).append((v, i))
        for found in owners.values():
            if len(found) > 1:
                for v, i in found:
                    bits[v] |= 1 << i
        for (windows, row, whole), own in zip(variants, bits):
            if not whole and own:
                put(row, own)

    def flush() -> pa.RecordBatch:
        done = pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)
        for column in out.values():
            column.clear()
        return done

    group, variants = None, []
    for batch in batches:
        for seed, windows, doc, tag, start, twice in zip(*(c.to_pylist() for c in batch.columns)):
            row, every = (doc, tag, start), (1 << len(windows) // 6) - 1
            if seed != group:
                close(variants)
                group, variants = seed, []
            if variants and variants[-1][0] == windows:
                last = variants[-1]
                if not last[2]:
                    put(last[1], every)
                    last[2] = True
                put(row, every)
            else:
                variants.append([windows, row, twice])
                if twice:
                    put(row, every)
        yield flush()
    close(variants)
    yield flush()


def as_text(numbers: np.ndarray, digits: int) -> str:
    """Numbers of words as ``digits`` characters each, every place of a digit with characters of its own."""
    places = np.arange(digits)
    codes = (numbers[:, None] >> places * DIGIT_BITS & (1 << DIGIT_BITS) - 1) + (places << DIGIT_BITS)
    return codes.astype("<u2").tobytes().decode("utf-16-le")


class Automaton:
    """Passages as sequences of word numbers, found by blocks of which each window holds at least one.

    Numbers are below ``words``. The automaton runs over their digits, as it looks for a node's successor one by one: with
    a character for each word its root would have as many as there are words. A match begins and ends with a word, because
    every place of a digit has its own characters.
    """

    def __init__(self, passages: list[np.ndarray], size: int, words: int):
        self.size, self.block = size, (size + 1) // 2
        self.passages = passages
        self.digits = max(1, -(-(words - 1).bit_length() // DIGIT_BITS))
        self.places: dict[str, list[tuple[int, int]]] = {}
        self.find = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_STRING)
        for number, passage in enumerate(passages):
            whole = as_text(passage, self.digits)
            for at in range(0, len(passage) - self.block + 1, self.block):
                key = whole[at * self.digits : (at + self.block) * self.digits]
                if key in self.places:
                    self.places[key].append((number, at))
                else:
                    self.places[key] = [(number, at)]
                    self.find.add_word(key, self.places[key])
        if passages:
            self.find.make_automaton()

    def covered(self, words: np.ndarray) -> np.ndarray | None:
        """Which words lie in a stretch of at least ``size`` words that a passage has too; None if no block is found."""
        if not self.passages or len(words) < self.size:
            return None
        out = None
        done_low = done_high = 0  # the stretch covered last
        tried: set[tuple[int, int]] = set()
        for end, found in self.find.iter(as_text(words, self.digits)):
            if out is None:
                out = np.zeros(len(words), bool)
            for number, at in found:
                offset = end // self.digits - self.block + 1 - at
                if (number, offset) in tried:
                    continue
                tried.add((number, offset))
                passage = self.passages[number]
                low, high = max(0, offset), min(len(words), offset + len(passage))
                if high - low < self.size or done_low <= low and high <= done_high:
                    continue
                other = np.flatnonzero(words[low:high] != passage[low - offset : high - offset])
                if not len(other):
                    out[low:high] = True
                    done_low, done_high = low, high
                    continue
                edges = np.concatenate(([-1], other, [high - low]))
                for i in np.flatnonzero(np.diff(edges) > self.size):
                    out[low + edges[i] + 1 : low + edges[i + 1]] = True
        return out


class _Numbers(dict):
    """Words of a shard to numbers, in the order they are met."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def passages_of(words: np.ndarray, starts: np.ndarray, size: int) -> list[np.ndarray]:
    """Stretches of consecutive recurring windows."""
    if not len(starts):
        return []
    cuts = np.flatnonzero(np.diff(starts) > 1) + 1
    return [words[run[0] : run[-1] + size] for run in np.split(starts, cuts)]


def _removed(size: int, with_text: bool, body: str, places: str):
    """``body`` and ``places`` name the columns of the words' text and of the recurring windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, held = 0, 0
            lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(body)), 0).to_pylist()
            for row, length in enumerate(lengths):
                held += length
                if held > SHARD_BYTES or row == batch.num_rows - 1:
                    yield shard(batch.slice(begin, row + 1 - begin))
                    begin, held = row + 1, 0

    def shard(batch: pa.RecordBatch) -> pa.RecordBatch:
        numbers = _Numbers()
        seen: set[bytes] = set()  # windows that a passage holds already
        texts, rows, passages = [], [], []
        found = batch.column(places)
        edges = np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(found), 0).to_numpy())])
        stretches = found.flatten()
        begins, bits = (stretches.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("start", "bits"))
        for at, text in enumerate(batch.column(body).to_pylist()):
            words = text.split()
            row = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
            texts.append(words)
            rows.append(row)
            if edges[at] < edges[at + 1]:
                own = slice(edges[at], edges[at + 1])
                which, shift = np.nonzero(bits[own, None] >> np.arange(32) & 1)
                starts = np.unique(begins[own][which] + shift)
                mixed = _mixed(row.astype(np.uint64) + _C)
                keys = np.stack([_runs(mixed, size)[starts], _runs(_mixed(mixed ^ _B), size)[starts]], axis=1).tobytes()
                fresh = []
                for n, start in enumerate(starts.tolist()):
                    window = keys[16 * n : 16 * n + 16]
                    if window not in seen:
                        seen.add(window)
                        fresh.append(start)
                passages += passages_of(row, np.array(fresh, np.int64), size)
        automaton = Automaton(passages, size, len(numbers))
        counts, removed, hashes, kept_texts = [], [], [], []
        for words, row in zip(texts, rows):
            gone = automaton.covered(row)
            kept = b" ".join(words if gone is None else [w for w, g in zip(words, gone.tolist()) if not g])
            counts.append(len(words))
            removed.append(0 if gone is None else int(gone.sum()))
            hashes.append(hashlib.sha256(kept).hexdigest())
            kept_texts.append(kept)
        names = [n for n in batch.schema.names if n not in (body, places, "text")]
        columns = [batch.column(n) for n in names] + [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(hashes)]
        names += ["n_words", "n_removed", "kept_sha256"]
        if with_text:
            columns.append(pa.array(kept_texts, pa.binary()).cast(pa.string()))
            names.append("text")
        return pa.RecordBatch.from_arrays(columns, names=names)

    return run


def remove_repeated(docs: DataFrame, size: int = WINDOW, seed: int = SEED, with_text: bool = True) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed``, ``kept_sha256`` and, if wanted, ``text`` as the kept words joined by a space.

    Words are what stands between white space (space, 0x09 to 0x0D), unchanged. A word goes if it lies in
    a window of ``size`` words that starts anywhere else too, in the same row or another. Null and
    empty texts have no words, and texts shorter than a window keep all. Rows are texts of
    their own, with null or repeated doc_ids too; a row that is there twice repeats itself and loses
    all its windows. Other columns pass through and columns with the new names are replaced.
    """
    if not 1 < seed < size or size - seed + 1 > 30:
        raise ValueError("a seed must be shorter than the window, by 29 words at most")
    docs = docs.drop("n_words", "n_removed", "kept_sha256")
    key, mark, key_found, mark_found, body, places = unused(docs, "key", "mark", "key_found", "mark_found", "body", "places")
    rows = _rows(docs)
    seeds = map_batches(rows, _seeds(size, seed), "seed long, doc long, tag long, twice boolean")
    recurring = stored(
        map_batches(seeds.repartition("seed").sortWithinPartitions("seed"), _recurring, "seed long, doc long, tag long"), "recurring-seeds"
    )
    frequent = stored(recurring.groupBy("seed").count().where(F.col("count") >= HOT).select("seed"), "frequent-seeds")
    per_text = lambda of: of.groupBy("doc", "tag").agg(F.collect_set("seed").alias("seeds"))
    windows = lambda of, single: map_batches(rows.join(per_text(of), ["doc", "tag"]), _windows(size, seed, single), _WINDOWS)
    dealt = windows(recurring.join(frequent, "seed", "left_anti"), False).repartition("seed").sortWithinPartitions("seed", "windows")
    found = map_batches(dealt, _confirmed, "doc long, tag long, start int, bits int")
    if not frequent.isEmpty():
        single = stored(windows(recurring.join(frequent, "seed", "left_semi"), True), "frequent-windows")
        counted = single.groupBy("seed", "windows").agg(F.count("*").alias("n"), F.max("twice").alias("twice")).where("n > 1 OR twice")
        again = single.join(counted.select("seed", "windows"), ["seed", "windows"])
        found = found.unionByName(again.select("doc", "tag", "start", F.lit(1).alias("bits")))
    per_doc = found.groupBy(F.col("doc").alias(key_found), F.col("tag").alias(mark_found)).agg(F.collect_list(F.struct("start", "bits")).alias(places))
    doc, tag = _name(docs)
    keyed = docs.withColumns({key: doc, mark: tag, body: F.coalesce(F.col("text"), F.lit("")).cast("binary")})
    joined = keyed.join(per_doc, (F.col(key) == F.col(key_found)) & (F.col(mark) == F.col(mark_found)), "left")
    joined = joined.drop(key, mark, key_found, mark_found, "text")
    added = [StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_sha256", StringType())]
    if with_text:
        added.append(StructField("text", StringType()))
    schema = StructType([*[f for f in docs.schema.fields if f.name != "text"], *added])
    return map_batches(joined, _removed(size, with_text, body, places), schema)
