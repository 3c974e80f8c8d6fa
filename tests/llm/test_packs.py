"""Counts of tokens and pairs that travel in packs, against plain counting."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from salescope.llm import language_model as lm
from salescope.llm.common import map_batches


def test_token_counts_against_plain_counting(spark, monkeypatch):
    monkeypatch.setattr(lm, "HELD_TOKENS", 3)
    monkeypatch.setattr(lm, "PART_BYTES", 20)
    texts = [None, "", " \t\n", "A a\x00 a \x0bB", "b É é é", "x" * 300, "a a", "A a\x00 a \x0bB"]
    docs = spark.createDataFrame([(t.encode() if t is not None else None,) for t in texts], "text binary").repartition(3)
    want = Counter(w for t in texts for w in lm.tokens(t.encode() if t is not None else None))
    assert want[b"a"] == 6 and want["É".encode()] == 1 and want[lm.END] == len(texts)
    rows = lm.token_counts(docs).collect()
    assert len(rows) == len(want) and {bytes(r["token"]): r["n"] for r in rows} == want
    assert lm.token_counts(docs.limit(0)).count() == 0


def test_packs_give_back_keys_and_sums():
    draw = np.random.default_rng(1)
    want, batches = Counter(), []
    for _ in range(4):
        keys, n = np.unique(draw.integers(0, 2**36, 500) // 2**27, return_counts=True)
        want.update(dict(zip(keys.tolist(), n.tolist())))
        parts = lm._mixed(keys, 7)
        assert len(set(parts.tolist())) == 7
        batches += lm._packs(keys, n, parts)
    packs = pa.Table.from_batches(batches)
    found = {}
    for part in set(packs.column("part").to_pylist()):
        own = packs.filter(pa.compute.equal(packs.column("part"), part))
        assert sum(own.column("size").to_pylist()) >= 1
        summed = lm._summed(own)
        assert summed.num_rows == 1
        found |= dict(zip(*(x.tolist() for x in lm._unpacked(summed))))
    assert found == want
    assert list(lm._packs(*[np.empty(0, np.int64)] * 3)) == []


@pytest.mark.parametrize("turned", [False, True])
def test_pairs_are_dealt_by_whole_classes(turned, monkeypatch):
    monkeypatch.setattr(lm, "FITTED_PAIRS", 5)
    width, draw = 30, np.random.default_rng(2)
    keys, n = np.unique(draw.integers(0, width * width, 400), return_counts=True)
    dealt = pa.Table.from_batches(lm._dealt(width, 4, turned)(lm._packs(keys, n, lm._mixed(keys, 3))))
    got, owners = {}, []
    for part in set(dealt.column("part").to_pylist()):
        for row in lm._gathered(width)(dealt.filter(pa.compute.equal(dealt.column("part"), part))).to_pylist():
            ids, starts, totals = np.frombuffer(row["ids"], np.int32), np.frombuffer(row["starts"], np.int32), np.frombuffer(row["totals"], np.int64)
            to, times = lm._whole(row["to"], row["size"], np.int32), lm._whole(row["n"], row["size"])
            assert len(ids) == 1 or len(to) <= 5
            owners += ids.tolist()
            for i, own in enumerate(np.repeat(ids, np.diff(starts, append=len(to))).tolist()):
                got[(int(to[i]), own) if turned else (own, int(to[i]))] = int(times[i])
            assert totals.tolist() == np.add.reduceat(times, starts).tolist()
    assert len(owners) == len(set(owners))
    assert got == {(int(k) // width, int(k) % width): int(c) for k, c in zip(keys, n)}


def test_a_pair_counted_by_several_tasks_is_one(spark):
    once = spark.createDataFrame([(p, 4) for p in range(9)], "pair long, n long")
    parts = spark.createDataFrame([(p, 2) for p in range(9)] * 2, "pair long, n long").repartition(4)
    for a, b in zip(lm.fit_pairs(once, 3), lm.fit_packs(map_batches(parts, lm._packed(5), lm.PACKS), 3)):
        assert np.array_equal(a, b)
