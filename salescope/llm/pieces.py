"""SentencePiece BPE encoding through a table of each prefix's last token.

The merges of a BPE model are settled by one fact: a sequence of tokens is the
encoding of its text exactly when every two neighbours are compatible, that is, when
encoding their joined text gives the two back. So every prefix of a word has exactly
one possible last token. An Aho-Corasick automaton over the pieces gives the tokens that
end at a position; the one that is compatible with the last token of the prefix before
it is stored. The ids are then read from the table backwards.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from salescope.llm.common import kept_by_worker, map_batches

SPACE = "▁"
CACHED_WORDS = 400_000  # of a Python worker; half of them go when full, those that were not met lately
CACHED_PAIRS = 1_000_000  # of a Python worker; emptied when full


class PieceTable:
    """Encoder for one model file. Only models with identity normalisation and byte fallback are taken."""

    def __init__(self, path: str):
        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bos, self.eos = model.bos_id(), model.eos_id()
        plain = [
            i for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))
        ]
        self.ids = {model.id_to_piece(i): i for i in plain}
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        score = {p: model.get_score(i) for p, i in self.ids.items()}
        # Runs of spaces share the lowest score and are merged after everything else, from the left.
        self.runs = {p for p in self.ids if len(p) > 1 and not p.strip(SPACE)}
        words = {p for p in self.ids if p not in self.runs}
        merged = sorted((p for p in words if len(p) > 1), key=lambda p: -score[p])
        tied = len({score[p] for p in merged}) < len(merged)
        inner = any(SPACE in p[1:] for p in words)
        if tied or inner or model.piece_to_id(SPACE) not in plain or any(b == model.unk_id() for b in self.byte_ids):
            raise ValueError("not a BPE model with distinct scores, leading space marks and byte fallback")
        self.rank = {p: n for n, p in enumerate(merged)}
        self.run_rank = {p: (len(merged) if score[p] == min(score.values()) else -1) for p in self.runs}
        if -1 in self.run_rank.values():
            raise ValueError("runs of spaces must have the lowest score")
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.left: dict[str, list[tuple[str, int]]] = {}
        self.right: dict[str, list[tuple[str, int]]] = {}
        for p in sorted(words, key=len):
            if len(p) > 1 and not self._reachable(p):
                continue
            self.automaton.add_word(p, self.ids[p])
        self.automaton.make_automaton()
        self.alphabet = {p for p in words if len(p) == 1}
        self.total = model.get_piece_size()
        self.sizes = [len(model.id_to_piece(i)) for i in range(self.total)]
        self.known_pairs: dict[int, bool] = {}
        # Words end before a space mark that follows another character, and at characters no piece holds.
        inside = re.escape("".join(sorted({c for p in words for c in p} - {SPACE})))
        self.split = re.compile(f"{SPACE}*[{inside}]+|{SPACE}+|[^{SPACE}{inside}]+")
        self.cache = _Words(self)

    # -- merges

    def _merge(self, symbols: list[str], rank: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
        """Merge best-ranked neighbours first, the leftmost of equals; also the pair that was merged last."""
        after = list(range(1, len(symbols) + 1))
        before = list(range(-1, len(symbols) - 1))
        queue: list[tuple[int, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(symbols):
                joined = symbols[i] + symbols[after[i]]
                if joined in rank:
                    heapq.heappush(queue, (rank[joined], i, joined))

        for i in range(len(symbols)):
            offer(i)
        last = None
        while queue:
            _, i, joined = heapq.heappop(queue)
            j = after[i]
            if not symbols[i] or j >= len(symbols) or symbols[i] + symbols[j] != joined:
                continue
            last = (symbols[i], symbols[j])
            symbols[i], symbols[j], after[i] = joined, "", after[j]
            if after[i] < len(symbols):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [s for s in symbols if s], last

    def _reachable(self, piece: str) -> bool:
        """Does the piece encode to itself? If so, note the tokens along its left and right edge.

        An edge lists (token, rank of the merge that takes the token in), from the piece itself inwards.
        """
        out, pair = self._merge(list(piece), self.rank)
        if out != [piece]:
            return False
        own = self.rank[piece]
        a, b = pair
        if any(len(x) > 1 and self.rank[x] > own for x in pair):
            raise ValueError(f"the parts of {piece!r} rank after it")
        self.left[piece] = [(a, own), *self.left.get(a, [])]
        self.right[piece] = [(b, own), *self.right.get(b, [])]
        return True

    def _compatible(self, one: str, two: str) -> bool:
        """Would no merge across their border come before both are complete?"""
        never = len(self.rank)
        ends = [(one, never), *self.right.get(one, [])]
        starts = [(two, never), *self.left.get(two, [])]
        for end, end_taken in ends:
            end_made = self.rank.get(end, -1)
            for start, start_taken in starts:
                start_made = self.rank.get(start, -1)
                if start_taken <= end_made or end_taken <= start_made:
                    continue  # the two never stand side by side
                across = self.rank.get(end + start)
                # the border pair lies right of a merge within `one` and left of one within `two`
                if across is not None and across < end_taken and across <= start_taken:
                    return False
        return True

    # -- encoding

    def tokens(self, word: str) -> list[int]:
        """Ids of a text of known characters without runs of spaces."""
        last = [0] * len(word)
        sizes, known, total = self.sizes, self.known_pairs, self.total
        done = -1
        for end, token in self.automaton.iter(word):
            if end == done:
                continue  # the only possible last token of this prefix is found
            start = end - sizes[token]
            if start >= 0:
                pair = last[start] * total + token
                fits = known.get(pair)
                if fits is None:
                    fits = self._judged(pair)
                if not fits:
                    continue
            last[end] = token
            done = end
        out = []
        end = len(word) - 1
        while end >= 0:
            out.append(last[end])
            end -= sizes[last[end]]
        return out[::-1]

    def _judged(self, pair: int) -> bool:
        if len(self.known_pairs) >= CACHED_PAIRS:
            self.known_pairs.clear()
        one, two = divmod(pair, self.total)
        fits = self.known_pairs[pair] = self._compatible(self.model.id_to_piece(one), self.model.id_to_piece(two))
        return fits

    def word_ids(self, word: str) -> list[int]:
        if word[0] != SPACE and word[0] not in self.alphabet:
            return [self.byte_ids[b] for b in word.encode("utf-8")]
        spaces = len(word) - len(word.lstrip(SPACE))
        if spaces < 2:
            return self.tokens(word)
        rest = self.tokens(SPACE + word[spaces:]) if len(word) > spaces else []
        if rest and rest[0] != self.ids[SPACE]:
            spaces -= 1  # the last space belongs to the first token of the word
        else:
            rest = rest[1:]
        run, _ = self._merge([SPACE] * spaces, self.run_rank)
        return [self.ids[t] for t in run] + rest

    def encode(self, text: str) -> bytes:
        """Ids with begin and end, as little-endian unsigned 32-bit integers."""
        words = self.split.findall(SPACE + text.replace(" ", SPACE)) if text else []
        out = b"".join(map(self.cache.__getitem__, words))
        if len(self.cache) > CACHED_WORDS // 2:
            self.cache.age()
        return b"".join((self.bos.to_bytes(4, "little"), out, self.eos.to_bytes(4, "little")))


class _Words(dict):
    """Ids of words seen lately; those of the generation before come back when they are met again."""

    def __init__(self, table: PieceTable):
        super().__init__()
        self.table = table
        self.before: dict[str, bytes] = {}

    def age(self) -> None:
        self.before = dict(self)
        self.clear()

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            found = self.table.word_ids(word)
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(word) <= 64:
            self[word] = ids
        return ids


@kept_by_worker
def piece_table(path: str) -> PieceTable:
    return PieceTable(path)


def _encoded(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(path)
        for batch in batches:
            whole = pa.Table.from_batches([batch])
            step = max(1, batch.num_rows // (1 + whole.nbytes // (8 << 20)))  # ids of some 8 MB of text at a time
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids, counts, id_hashes, text_hashes = [], [], [], []
                for text in part.column("text").to_pylist():
                    coded = table.encode(text or "")
                    decoded = table.model.decode(np.frombuffer(coded, dtype="<u4").tolist())
                    ids.append(coded)
                    counts.append(len(coded) // 4)
                    id_hashes.append(hashlib.sha256(coded).hexdigest())
                    text_hashes.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
                columns = [part.column(n) for n in part.schema.names if n != "text"]
                names = [n for n in part.schema.names if n != "text"]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(x, dtype="<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())))
                    names.append("ids")
                columns += [pa.array(counts, pa.int64()), pa.array(id_hashes), pa.array(text_hashes)]
                yield pa.RecordBatch.from_arrays(columns, names=names + ["n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_texts(docs: DataFrame, model_path: str, with_ids: bool = True) -> DataFrame:
    """Replace ``text`` by ``ids`` (if wanted), ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.

    Ids are those of the sentencepiece library with begin and end ids and no sampling; the
    decoded text is what its ``decode`` gives. A null text is taken as empty. Every row is
    encoded on its own, so repeated rows, ties and empty tables need no rule; other columns
    pass through, and columns with the names of the new ones are replaced. ``model_path`` must
    be readable on every worker, as the installed tokenizer files are.
    """
    docs = docs.drop("ids", "n_tokens", "ids_sha256", "decoded_sha256")
    added = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    fields = [f for f in docs.schema.fields if f.name != "text"]
    if with_ids:
        from pyspark.sql.types import ArrayType, IntegerType

        fields.append(StructField("ids", ArrayType(IntegerType())))
    return map_batches(docs.withColumn("text", F.coalesce("text", F.lit(""))), _encoded(model_path, with_ids), StructType(fields + added))


def decode_ids(ids: list[int], model_path: str) -> str:
    """Text of ids, begin and end ids left out."""
    return piece_table(model_path).model.decode(list(ids))
