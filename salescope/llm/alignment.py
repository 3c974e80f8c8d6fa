"""Alignment of the tokens of two tokenizers over the same texts, and what their tokens stand for in each other.

Both tokenizers take the whole text, and their tokens' bytes are checked against it. Where both have a token end and
both go on with a token that starts with a space, the text is cut into windows. What the tokens of
a window make of each other (the groups between shared ends, and the linked pairs of ids) follows from
the two tuples of ids alone and is remembered by them; a word's window is remembered by the word.

How many documents hold a pair of ids linked is counted over all documents from what was stored
for each. The counts of the ``HEAD`` most frequent pairs go to every task; those of all others are joined.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from salescope.functions.ranking import ordered_bin
from salescope.llm.common import kept_by_worker, map_batches, stored, unused

SPACE = "▁"
HEAD = 1_000_000  # pairs whose counts go to every task
CACHED_WINDOWS = 400_000  # of a Python worker; emptied when full
TEXT_BYTES = 4 << 20  # that a task aligns at a time, or one text
HELD_PAIRS = 1_000_000  # that a counting task holds at a time

# Fixed value: the pieces that byte-level BPE cuts a text into before it merges.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Before a space between other characters neither tokenizer has a token that reaches across.
_WORD_START = re.compile(r"(?<=[^ ▁]) (?=[\w!-~])")


def byte_of_character() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


def byte_level_encoder(path: str) -> tuple[tiktoken.Encoding, list[bytes]]:
    """Encoder for a tokenizers file of byte-level BPE, and the bytes of each id. Texts of special tokens are plain.

    The ranks are the file's own ids, which number its merges in order; so tiktoken merges as the tokenizers
    library does, some three times as fast.
    """
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    model, before = content["model"], content["pre_tokenizer"]
    spelling = byte_of_character()
    ranks = {bytes(spelling[c] for c in token): i for token, i in model["vocab"].items() if all(c in spelling for c in token)}
    parts = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in parts]
    if content["normalizer"] or before["type"] != "ByteLevel" or not before["use_regex"] or made != sorted(made) or min(made) <= max(model["vocab"][c] for c in spelling):
        raise ValueError("not a byte-level BPE file whose ids number its merges")
    of_id = [b""] * (1 + max(model["vocab"].values()))
    for token, i in ranks.items():
        of_id[i] = token
    return tiktoken.Encoding("byte-level", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={}), of_id


class Pair:
    """A byte-level BPE file of the tokenizers library (A) and a sentencepiece model with byte pieces (B)."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.a_bytes = byte_level_encoder(a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_total = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.b_total)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        # Only then a text's words can be encoded one by one: no piece goes on after a space mark inside it.
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.a_size, self.b_size = [len(t) for t in self.a_bytes], [len(t) for t in self.b_bytes]
        self.a_text, self.b_text = [str(i) for i in range(len(self.a_bytes))], [str(i) for i in range(self.b_total)]
        self.forget()

    def forget(self) -> None:
        """Empty the memory of windows; number 0 stays for words that are not spelled out."""
        self.words: dict[str, int] = {}
        self.windows: dict[tuple[tuple[int, ...], tuple[int, ...]], int] = {((), ()): 0}
        self.text = [""]
        self.n_a, self.n_b, self.groups, self.links, self.first = (array("q", [0]) for _ in range(5))
        self.keys = array("q")

    def window(self, a: tuple[int, ...], b: tuple[int, ...]) -> int:
        """Number of a window, by its ids; what is new is aligned."""
        number = self.windows.get((a, b))
        if number is not None:
            return number
        a_size, b_size, a_text, b_text, total = self.a_size, self.b_size, self.a_text, self.b_text, self.b_total
        groups, pairs = [], []
        i = j = i0 = j0 = gap = 0  # gap: bytes that the tokens of A so far are ahead of those of B
        while i < len(a):
            gap += a_size[a[i]]
            i += 1
            while gap > 0:
                gap -= b_size[b[j]]
                j += 1
            if gap == 0:
                if i - i0 == 1 == j - j0:
                    groups.append(f"{a_text[a[i0]]}|{b_text[b[j0]]}")
                    pairs.append(a[i0] * total + b[j0])
                else:
                    groups.append(",".join([a_text[x] for x in a[i0:i]]) + "|" + ",".join([b_text[y] for y in b[j0:j]]))
                    pairs += [x * total + y for x in a[i0:i] for y in b[j0:j]]
                i0, j0 = i, j
        number = self.windows[a, b] = len(self.text)
        self.text.append(";".join(groups))
        self.n_a.append(len(a))
        self.n_b.append(len(b))
        self.groups.append(len(groups))
        self.links.append(len(pairs))
        self.first.append(len(self.keys))
        self.keys.extend(pairs)
        return number

    def _spelled(self, word: str, a: list[int], b: list[int]) -> bool:
        a_bytes, b_bytes = self.a_bytes, self.b_bytes
        return b"".join([a_bytes[i] for i in a]) == (" " + word).encode() == b"".join([b_bytes[i] for i in b])

    def _learn(self, new: list[str]) -> None:
        encode, window = self.a.encode_ordinary, self.window
        for word, b in zip(new, self.b.encode(new, num_threads=1)):
            a = encode(" " + word)
            self.words[word] = window(tuple(a), tuple(b)) if self._spelled(word, a, b) else 0

    def split(self, texts: list[str | None]) -> list[list[int]]:
        """The windows of every text, none where a tokenizer does not spell out a space and the text.

        The tokens of a text are those of its words in turn. Where both spell out a word, it ends at a shared end, and the next
        word's first tokens are marked with the space before it: so words are the windows.
        """
        if len(self.words) > CACHED_WINDOWS:
            self.forget()
        cut = [(_WORD_START.split(t) if self.by_word else [t]) if t else [] for t in texts]
        self._learn(list(set().union(*cut).difference(self.words)))
        found = [list(map(self.words.__getitem__, words)) for words in cut]
        for at, numbers in enumerate(found):
            if 0 in numbers:  # each word differs from its tokens, but perhaps not all of them together
                a = [i for w in cut[at] for i in self.a.encode_ordinary(" " + w)]
                b = [i for w in self.b.encode(cut[at], num_threads=1) for i in w]
                found[at] = [self.window(tuple(a), tuple(b))] if self._spelled(texts[at], a, b) else []
        return found

    def align(self, texts: list[str | None], with_groups: bool) -> dict[str, list | np.ndarray]:
        """Counts, digest (or groups) and linked pairs of every text."""
        split = self.split(texts)
        n = len(texts)
        numbers = np.array([w for windows in split for w in windows], np.int64)
        doc = np.repeat(np.arange(n), [len(windows) for windows in split])

        def total(values: array) -> np.ndarray:
            return np.bincount(doc, np.frombuffer(values, np.int64)[numbers], n).astype(np.int64)

        joined = [";".join([self.text[w] for w in windows]) for windows in split]
        shown = joined if with_groups else [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in joined]
        found = {"n_a": total(self.n_a), "n_b": total(self.n_b), "n_groups": total(self.groups), "n_links": total(self.links), "groups": shown}
        sizes, starts = np.frombuffer(self.links, np.int64)[numbers], np.frombuffer(self.first, np.int64)[numbers]
        at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        whole = len(self.a_bytes) * self.b_total
        pairs = np.frombuffer(self.keys, np.int64)[at] if len(at) else np.zeros(0, np.int64)
        mixed, times = np.unique(np.repeat(doc, sizes) * whole + pairs, return_counts=True)
        cuts = np.searchsorted(mixed, np.arange(n + 1) * whole).tolist()
        plain, times = (mixed % whole).astype(np.uint32 if whole < 2**32 else np.uint64), times.astype(np.uint32)
        found["keys"] = [plain[p:q].tobytes() for p, q in zip(cuts, cuts[1:])]
        found["times"] = [times[p:q].tobytes() for p, q in zip(cuts, cuts[1:])]
        return found


@kept_by_worker
def tokenizer_pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def _aligned(a_path: str, b_path: str, text: str, names: dict[str, str], with_groups: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizer_pair(a_path, b_path)
        for batch in batches:
            texts = batch.column(text).to_pylist()
            passed = [c for c in batch.schema.names if c != text]
            begin = 0
            while begin < len(texts):
                end, size = begin, 0
                while end < len(texts) and (end == begin or size + len(texts[end] or "") <= TEXT_BYTES):
                    size += len(texts[end] or "")
                    end += 1
                found = pair.align(texts[begin:end], with_groups)
                part = batch.slice(begin, end - begin)
                kinds = {"groups": pa.string(), "keys": pa.binary(), "times": pa.binary()}
                columns = [part.column(c) for c in passed] + [pa.array(v, kinds.get(k, pa.int64())) for k, v in found.items()]
                yield pa.RecordBatch.from_arrays(columns, names=passed + [names[k] for k in found])
                begin = end

    return run


def _pair_rows(kind: str):
    """(key, n): in how many rows each key is, added up in the task as far as it holds them."""
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)

        for batch in batches:
            column = batch.column(0)
            for begin in range(0, len(column), 1_000):
                whole = b"".join(column.slice(begin, 1_000).to_pylist())
                keys, n = np.unique(np.frombuffer(whole, kind), return_counts=True)
                held.append((keys.astype(np.int64), n))
                if sum(len(k) for k, _ in held) > HELD_PAIRS:
                    held = [merged()]
                    if len(held[0][0]) > HELD_PAIRS // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held.pop()], schema=schema)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in merged()], schema=schema)

    return run


def _rated(head, kind: str, names: dict[str, str], extra: list[str]):
    """Adds up the counts of the pairs of the head; the others' keys and times remain as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = head.value
        for batch in batches:
            n_best, count_sum, rest, rest_times = [], [], [], []
            for k, t in zip(batch.column(names["keys"]).to_pylist(), batch.column(names["times"]).to_pylist()):
                own, times = np.frombuffer(k, kind).astype(np.int64), np.frombuffer(t, np.uint32).astype(np.int64)
                at = np.searchsorted(keys, own)
                at[at == len(keys)] = 0
                known = keys[at] == own if len(keys) else np.zeros(len(own), bool)
                n_best.append(int(times[known] @ best[at[known]]) if len(keys) else 0)
                count_sum.append(int(times[known] @ counts[at[known]]) if len(keys) else 0)
                rest.append(own[~known])
                rest_times.append(times[~known])
            passed = [c for c in batch.schema.names if c not in (names["keys"], names["times"])]
            lists = pa.list_(pa.int64())
            columns = [batch.column(c) for c in passed] + [pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), pa.array(rest, lists), pa.array(rest_times, lists)]
            yield pa.RecordBatch.from_arrays(columns, names=passed + extra)

    return run


def _head(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, counts and marks of the most frequent pairs, at most ``HEAD``, cut between classes of frequency."""
    classes = counts.groupBy(ordered_bin(F.col("n").cast("double")).alias("class")).count().orderBy(F.desc("class")).collect()
    taken, last = 0, None
    for row in classes:
        if taken + row["count"] > HEAD:
            break
        taken, last = taken + row["count"], row["class"]
    if last is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    top = counts.where(ordered_bin(F.col("n").cast("double")) >= last).limit(HEAD).toArrow()
    key, n, best = (top.column(c).to_numpy() for c in ("key", "n", "best"))
    order = np.argsort(key)
    return key[order], n[order], best[order].astype(np.int64)


def align_tokens(docs: DataFrame, a_path: str, b_path: str, with_groups: bool = False) -> DataFrame:
    """``docs`` with ``n_a, n_b, n_groups, n_links, n_best, count_sum`` and ``groups_sha256`` in place of ``text``.

    ``a_path`` is a byte-level BPE file of the tokenizers library, ``b_path`` a sentencepiece model that puts a space
    first; A encodes a space and the text, B the text, without special tokens. Groups lie between byte offsets where
    tokens of both end; every A token of a group is linked with every B token of it. A pair's count is the number of
    rows that hold it linked; ``n_best`` counts links whose pair has the highest count of its A id, ties
    included, ``count_sum`` adds the counts of all links. ``with_groups`` gives ``groups``
    (``a1,a2|b1;a3|b2``) in place of the digest. A null or empty text, or one that a tokenizer does not spell out byte
    by byte, has zeros and an empty string. Repeated rows count as often as they occur. Other columns pass
    through; those named like a result are replaced. An empty table gives no rows.
    """
    shown = "groups" if with_groups else "groups_sha256"
    results = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", shown]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in results])
    row, keys, times, rest, rest_times = unused(docs, "row", "keys", "times", "rest", "rest_times")
    names = {"n_a": "n_a", "n_b": "n_b", "n_groups": "n_groups", "n_links": "n_links", "groups": shown, "keys": keys, "times": times}
    long = lambda name: StructField(name, LongType())
    passed = [f for f in docs.schema.fields if f.name != "text"]
    counted = [*passed, *[long(c) for c in results[:4]], StructField(shown, StringType())]
    coded = map_batches(docs, _aligned(a_path, b_path, "text", names, with_groups), StructType([*counted, StructField(keys, BinaryType()), StructField(times, BinaryType())]))
    aligned = stored(coded.withColumn(row, F.monotonically_increasing_id()), "aligned")

    pair = tokenizer_pair(a_path, b_path)
    kind = "<u4" if len(pair.a_bytes) * pair.b_total < 2**32 else "<u8"
    summed = stored(map_batches(aligned.select(keys), _pair_rows(kind), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "pair-counts")
    a_id = F.call_function("div", F.col("key"), F.lit(pair.b_total))
    highest = summed.groupBy(a_id.alias("a")).agg(F.max("n").alias("highest"))
    counts = stored(summed.withColumn("a", a_id).join(highest, "a").select("key", "n", (F.col("n") == F.col("highest")).alias("best")), "pair-ranks")
    spark = docs.sparkSession
    head = _head(counts)
    final = StructType([*counted, long(row), long("n_best"), long("count_sum"), *[StructField(c, ArrayType(LongType())) for c in (rest, rest_times)]])
    rated = map_batches(aligned, _rated(spark.sparkContext.broadcast(head), kind, names, ["n_best", "count_sum", rest, rest_times]), final)
    wanted = [f.name for f in passed] + results
    if len(head[0]) == counts.count():  # nothing is left to join
        return rated.select(*[f"`{c}`" for c in wanted])
    rated = stored(rated, "aligned-rated")
    zipped = F.arrays_zip(F.col(rest).alias("key"), F.col(rest_times).alias("times"))
    spread = rated.select(F.col(row).alias("row"), F.explode(zipped).alias("z")).select("row", "z.key", "z.times")
    rare = spread.join(counts, "key").groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("s"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("b"))
    rare = rare.select(F.col("row").alias(row), F.col("s").alias(rest), F.col("b").alias(rest_times))
    whole = rated.drop(rest, rest_times).join(rare, row, "left")
    added = {"n_best": F.col("n_best") + F.coalesce(rest_times, F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce(rest, F.lit(0))}
    return whole.withColumns(added).select(*[f"`{c}`" for c in wanted])
