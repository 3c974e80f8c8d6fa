"""Small cases of the operators on texts: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest

from salescope.llm.components import connected_components
from salescope.llm.contamination import contamination, item_words, phrase_candidates, positional_index, proximity_matches, benchmark_windows
from salescope.llm.jaccard import Bands, parity, shingle_hashes, shingle_set, signatures, similar_groups, wide_parity
from salescope.llm.language_model import fit_vectors, score_texts
from salescope.llm.lines import dedup_lines, levelled_runs, line_hashes
from salescope.llm.passages import Automaton, remove_repeated
from pyspark.sql import functions as F

DOCS = "doc_id long, text string"
EMPTY = [(1, None), (2, ""), (3, " \t\n\x0b ")]


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


# -- line dedup

LINE = "This line is certainly longer than forty characters."


def test_lines_keep_only_the_last_document(spark):
    rows = [(n, f"own {n}\n  {LINE.upper() if n % 2 else LINE}\t\nend") for n in range(6)] + EMPTY[:0]
    docs = spark.createDataFrame([*rows, (90, None), (91, ""), (92, LINE + "\n" + LINE)], DOCS)
    got = by_id(dedup_lines(docs))
    assert [got[n]["n_dropped"] for n in range(6)] == [1] * 6
    assert got[0]["text"] == "own 0\nend"
    assert got[92]["text"] == LINE + "\n" + LINE and got[92]["n_dropped"] == 0
    assert (got[90]["text"], got[90]["n_lines"]) == (None, 1)
    assert (got[91]["text"], got[91]["n_lines"]) == ("", 1)


def test_lines_need_five_documents_not_five_rows(spark):
    docs = spark.createDataFrame([(1, LINE)] * 9 + [(2, LINE + "\n" + LINE), (3, LINE), (4, LINE), (None, LINE)], DOCS)
    assert all(r["n_dropped"] == 0 for r in dedup_lines(docs).collect())


def test_lines_count_code_points_and_keep_other_columns(spark):
    short, long = "é" * 39, "é" * 40
    rows = [(n, f"{short}\n{long}", n, "kept") for n in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, key string")
    got = by_id(dedup_lines(docs))
    assert got[0]["text"] == short and got[4]["text"] == f"{short}\n{long}"
    assert got[0]["n_lines"] == 2 and got[0]["key"] == "kept"
    assert dedup_lines(docs.limit(0)).count() == 0


@pytest.mark.parametrize("batches", [1, 3, 5])
def test_runs_hold_each_hash_once(spark, batches):
    docs = spark.createDataFrame([(n, "\n".join(f"{LINE} {i % 7}" for i in range(n))) for n in range(12)], DOCS)
    runs, added, _ = levelled_runs(line_hashes(docs, 40, batches), batches, 2)
    keys = [bytes(r["key"]) for run in runs for r in run.collect()]
    assert len(keys) == len(set(keys)) == 7
    total = sum(r["n_docs"] for part in runs + added for r in part.collect())
    assert total == sum(min(n, 7) for n in range(12))


# -- contamination

def brute_contamination(docs, items, size=13):
    out = {}
    windows = []
    for item, text in items:
        w = item_words(text.encode() if text is not None else None)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.append((item, w[i : i + size]))
    for doc, text in docs:
        w = item_words(text.encode() if text is not None else None)
        hit, found = set(), set()
        for item, v in windows:
            for i in range(len(w) - len(v) + 1):
                if w[i : i + len(v)] == v:
                    hit |= set(range(i, i + len(v)))
                    if item is not None:
                        found.add(str(item))
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("block_terms", [40, 100_000])
def test_contamination_against_brute_force(spark, block_terms):
    random.seed(3)
    words = ["alpha", "beta", "Gamma", "d3", "ñu", "x"]
    text = lambda n: random.choice([" ", "-", ", "]).join(random.choice(words) for _ in range(n))
    items = [(10, text(20)), (9, text(13)), (2, text(5)), (2, text(14)), (3, None), (4, "?!"), (None, text(15)), (7, text(16))]
    docs = [(n, text(40)) for n in range(6)] + [(20 + n, f"{text(30)} {items[n % 3][1].upper()} {text(9)}") for n in range(6)]
    docs += [(None, items[1][1] + " z"), (40, None), (41, ""), (42, items[0][1]), (43, items[7][1] + " " + text(400)), (44, items[6][1])]
    frame = spark.createDataFrame([(*d, "old", 5) for d in docs], DOCS + ", n_hit string, digest int")
    got = by_id(contamination(frame, spark.createDataFrame(items, "item_id long, text string"), block_terms=block_terms))
    want = brute_contamination(docs, items)
    assert {k: (v["n_words"], v["n_hit"], v["n_items"], v["items_sha256"], v["contaminated"]) for k, v in got.items()} == want
    assert got[42]["digest"] == 5 and got[42]["hit_spans"] == [[0, 20]]


def test_contamination_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert by_id(contamination(docs, items))[1]["n_hit"] == 0
    assert contamination(docs.limit(0), items).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x x b x a b"), (2, "a x x x x b"), (3, "a a"), (None, "a b")], DOCS)
    index = positional_index(docs, frozenset([b"a", b"b"]))
    queries = spark.createDataFrame([(7, [b"a", b"b"])], "query_id int, terms array<binary>")
    found = sorted(tuple(r) for r in proximity_matches(index, queries, 4).collect())
    assert found == [(7, -(2**63), 0, 2), (7, 1, 5, 7)]
    assert sorted(tuple(r)[1:] for r in proximity_matches(index, queries, 6).collect()) == [(-(2**63), 0, 2), (1, 5, 7), (2, 0, 6)]


def test_phrase_lists_meet_at_shifted_offsets(spark):
    docs = spark.createDataFrame([(1, "b a b c"), (2, "a c b")], DOCS)
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    found = phrase_candidates(docs, benchmark_windows(items).select("digest", "terms"), anchors=3)
    assert [(r["doc_id"], r["start"]) for r in found.collect()] == [(1, 1)]


# -- Jaccard

def brute_groups(docs, share=85):
    sets = [(d, shingle_set((t or "").encode())) for d, t in docs]
    parent = {d: d for d, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= share * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets}


def edited(words, n):
    words = list(words)
    for _ in range(n):
        words[random.randrange(len(words))] = f"new{random.randrange(10**6)}"
    return words


def test_groups_against_brute_force(spark):
    random.seed(5)
    docs, number = [], 0
    for size in (3, 4, 5, 9, 14, 20, 40, 90, 300):
        base = [f"w{random.randrange(50)}" for _ in range(size)]
        for edits in (0, 0, 1, 1, 2, 3, 4, 6, 9):
            number += 7
            docs.append((number % 1009, " ".join(edited(base, edits if edits < size else 0))))
    docs += [(2000, None), (2001, ""), (2002, " \n"), (2003, "one"), (2004, "ONE"), (2005, "one\x0btwo")]
    frame = spark.createDataFrame([(*d, 1) for d in docs], DOCS + ", component_id int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar_groups(frame).collect()}
    assert got == brute_groups(docs)


def test_groups_of_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(5, "a b c d"), (5, "x y z w"), (6, "x y z w"), (3, "a b c d"), (None, "a b c d")], DOCS)
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in similar_groups(docs).collect())
    assert got == [(-1, -1), (3, 3), (5, 3), (5, 3), (6, 3)]
    assert similar_groups(docs.limit(0)).count() == 0


def test_any_two_linked_sets_share_a_signature():
    random.seed(11)
    bands = Bands()
    for _ in range(1500):
        size = random.choice([7, 8, 12, 20, 33, 60, 150, 400])
        a = np.unique(np.array([random.getrandbits(64) for _ in range(size)], np.uint64))
        most = int(0.15 / 1.85 * 2 * size)
        gone = random.randint(0, most)
        new = [random.getrandbits(64) for _ in range(random.randint(0, most - gone))]
        b = np.unique(np.concatenate([np.delete(a, random.sample(range(len(a)), min(gone, len(a) - 1))), np.array(new, np.uint64)]))
        common = len(np.intersect1d(a, b))
        if common < len(a) + len(b) - common and 100 * common >= 85 * (len(a) + len(b) - common):
            assert len(np.intersect1d(signatures(a, bands), signatures(b, bands)))


def test_sketches_differ_in_no_more_bits_than_the_sets():
    rng = np.random.default_rng(1)
    for size, cut in [(100, 3), (900, 200), (5_000, 900)]:
        one = rng.integers(0, 2**64, size, np.uint64)
        two = np.concatenate([one[cut:], rng.integers(0, 2**64, cut // 2, np.uint64)])
        for sketch in (parity, wide_parity):
            bits = sum(int(x).bit_count() for x in (sketch(one) ^ sketch(two)).view(np.uint64))
            assert 0 < bits <= cut + cut // 2
    assert wide_parity(one[:20]) is None


def test_shingle_hashes_count_shingles():
    for text in (b"", b"a", b"a b c", b"a b c d", b"A b c d a b c d e", b"x " * 50):
        assert len(shingle_hashes(text)) == len(shingle_set(text))


def test_components(spark):
    random.seed(2)
    links = [(random.randrange(400), random.randrange(400)) for _ in range(260)] + [(1000, n) for n in range(500, 560)] + [(n, n + 1) for n in range(700, 760)]
    parent = list(range(1001))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: find(n) for a, b in links for n in (a, b) if a != b}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- repeated passages

def brute_passages(docs, size):
    rows = [(d, (t or "").encode().split()) for d, t in docs]
    count = collections.Counter(tuple(w[i : i + size]) for _, w in rows for i in range(len(w) - size + 1))
    out = []
    for d, w in rows:
        gone = {p for i in range(len(w) - size + 1) if count[tuple(w[i : i + size])] > 1 for p in range(i, i + size)}
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((d if d is not None else -1, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("size,seed", [(35, 14), (6, 3)])
def test_passages_against_brute_force(spark, size, seed):
    random.seed(8)
    word = lambda: random.choice("ab") if random.random() < 0.5 else f"w{random.randrange(300)}"
    passages = [[word() for _ in range(random.randint(size - 2, 3 * size))] for _ in range(6)]
    docs = []
    for n in range(60):
        words = []
        for _ in range(random.randint(0, 4)):
            words += [word() for _ in range(random.randint(0, 20))]
            if random.random() < 0.5:
                p = random.choice(passages)
                words += p[random.randint(0, 3) : len(p) - random.randint(0, 3)]
        docs.append((n, " ".join(words)))
    docs += [(100, None), (101, ""), (102, "of " * 400), (103, "a b " * 90), (104, " ".join(passages[0])), (104, " ".join(passages[0])), (None, " ".join(passages[1]))]
    docs += [(105, "x"), (105, "of " * (size - 1))]
    frame = spark.createDataFrame([(*d, "old", 3) for d in docs], DOCS + ", n_words string, seed int")
    got = remove_repeated(frame, size, seed)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()) == brute_passages(docs, size)
    assert set(got.columns) == {"doc_id", "text", "seed", "n_words", "n_removed", "kept_sha256"}
    assert remove_repeated(frame.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [2, 5, 12])
def test_windows_of_frequent_seeds_are_counted_one_by_one(spark, monkeypatch, hot):
    from salescope.llm import passages

    monkeypatch.setattr(passages, "HOT", hot)
    random.seed(9)
    shared = [f"s{i}" for i in range(40)]
    docs = [(n, " ".join([f"p{random.randrange(99)}" for _ in range(9)] + shared[n % 4 :] + [f"q{random.randrange(99)}" for _ in range(9)])) for n in range(25)]
    got = remove_repeated(spark.createDataFrame(docs, DOCS))
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()) == brute_passages(docs, 35)


@pytest.mark.parametrize("words", [4, 2_000_000])
def test_automaton_finds_every_stretch(words):
    random.seed(1)
    passages = [np.array([random.randrange(4) for _ in range(random.randint(6, 20))]) for _ in range(5)]
    find = Automaton(passages, 6, words)
    windows = {tuple(p[i : i + 6]) for p in passages for i in range(len(p) - 5)}
    for _ in range(50):
        row = np.array([random.randrange(4) for _ in range(60)])
        want = np.zeros(60, bool)
        for i in range(55):
            if tuple(row[i : i + 6]) in windows:
                want[i : i + 6] = True
        got = find.covered(row)
        assert (np.zeros(60, bool) if got is None else got).tolist() == want.tolist()


def test_word_numbers_as_digits():
    from salescope.llm.passages import DIGIT_BITS, as_text

    base = 1 << DIGIT_BITS
    assert [ord(c) for c in as_text(np.array([0, 1, base, base * base + 2]), 3)] == [
        0, base, 2 * base, 1, base, 2 * base, 0, base + 1, 2 * base, 2, base, 2 * base + 1
    ]
    random.seed(3)
    numbers = np.array([random.randrange(10**9) for _ in range(2_000)])
    texts = {as_text(numbers[i : i + 1], 5) for i in range(len(numbers))}
    assert len(texts) == len(set(numbers.tolist()))


def test_columns_named_like_helpers_pass_through(spark):
    names = ["key", "mark", "key_found", "mark_found", "body", "places", "doc", "tag", "_doc", "_tag", "_text", "_found", "_mark"]
    shared = " ".join(f"w{i}" for i in range(40))
    frame = spark.createDataFrame([(1, shared), (2, "new " + shared), (3, "alone")], DOCS)
    wide = frame.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    got = {r["doc_id"]: r for r in remove_repeated(wide).collect()}
    assert [got[i]["n_removed"] for i in (1, 2, 3)] == [40, 40, 0]
    assert all(got[i][n] == f"{n}{i}" for i in got for n in names)


def test_rows_of_one_id_whose_texts_share_a_short_hash(spark):
    words = F.transform(F.sequence(F.lit(0), F.lit(40)), lambda k: F.concat(F.lit("w"), F.col("id").cast("string"), F.lit("x"), k.cast("string")))
    texts = spark.range(250_000).select(F.array_join(words, " ").alias("text")).withColumn("h", F.hash("text"))
    same = texts.groupBy("h").agg(F.collect_list("text").alias("t"), F.count("*").alias("n")).where("n > 1").first()["t"]
    docs = [(7, same[0]), (7, same[1]), (8, same[0] + " end")]
    got = remove_repeated(spark.createDataFrame(docs, DOCS)).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(7, 0), (7, 41), (8, 41)]


# -- language model

def test_scores_against_plain_counts(spark):
    random.seed(4)
    text = lambda: " ".join(random.choice(["a", "B", "b", "c", f"r{random.randrange(50)}"]) for _ in range(random.randint(0, 30)))
    rows = [(n, text(), n % 5 == 0) for n in range(60)] + [(60, None, False), (61, "zzz new", True), (61, "zzz new", True), (None, "a", True)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], DOCS + ", held_out boolean, score string")
    got = score_texts(docs, ~F.col("held_out")).collect()
    tokens = lambda t: (t or "").encode().lower().split() + [b"\n"]
    counts = collections.Counter(w for _, t, held in rows if not held for w in tokens(t))
    total, types = sum(counts.values()), len(counts)
    want = sorted(
        (d if d is not None else -1, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), total,
         round(sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (types + 1))) for w in tokens(t)), 6))
        for d, t, _ in rows
    )
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_rare_tokens_join_their_counts(spark, monkeypatch):
    from salescope.llm import language_model

    docs = spark.createDataFrame([(n, f"a a b{n} c{n % 3}") for n in range(30)], DOCS)
    whole = {r["doc_id"]: (r["n_known"], round(r["base_score"], 9)) for r in score_texts(docs, F.lit(True)).collect()}
    monkeypatch.setattr(language_model, "HEAD", 3)
    monkeypatch.setattr(language_model, "WORDS", 2)
    assert {r["doc_id"]: (r["n_known"], round(r["base_score"], 9)) for r in score_texts(docs, F.lit(True)).collect()} == whole
    assert score_texts(docs.limit(0), F.lit(True)).count() == 0
    unlearnt = score_texts(docs, F.lit(False)).collect()
    assert len(unlearnt) == 30 and all(r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in unlearnt)


def test_vectors_learn_what_follows_and_are_normalised():
    pairs = np.full((4, 4), 1)
    pairs[0, 1] = pairs[1, 2] = pairs[2, 0] = 500
    pairs[3, 3] = 300
    logs = fit_vectors(pairs)
    assert np.allclose(np.exp(logs.astype(float)).sum(axis=1), 1, atol=1e-4)
    assert [int(row.argmax()) for row in logs] == [1, 2, 0, 3]
    unigram = np.log(pairs.sum(axis=0) / pairs.sum())
    assert (pairs * logs).sum() > (pairs * unigram).sum() + 500


def test_words_beyond_the_most_frequent_have_context(spark):
    # 2,000 pairs of words, all of one frequency: half of them would share a class if the most frequent 1,500 had vectors
    docs = spark.createDataFrame([(n, f"a{n % 2_000} b{n % 2_000} " * 4) for n in range(4_000)], DOCS)
    odd = spark.createDataFrame([(-1 - n, f"a{n} b{(n + 1) % 2_000} " * 4) for n in range(2_000)], DOCS)
    every = docs.unionByName(odd)
    got = {r["doc_id"]: r["score"] for r in score_texts(every, F.col("doc_id") >= 0).collect()}
    better = sum(got[n] > got[-1 - n] + 2 for n in range(2_000))
    assert better >= 1_900


def test_vectors_fitted_together_equal_those_fitted_alone():
    from salescope.llm.language_model import VECTOR, _improved

    draw = np.random.default_rng(4)
    other = draw.standard_normal((300, VECTOR + 1)).astype(np.float32)
    sizes = np.array([1, 1, 2, 3, 40, 41, 5, 1, 260, 7])
    starts = np.cumsum(sizes) - sizes
    to, n, drawn = draw.integers(0, 300, sizes.sum()), draw.integers(1, 9, sizes.sum()), draw.integers(0, 300, 50)
    for biased in (False, True):
        together = _improved(starts, to, n, other, drawn, biased)
        for i, (at, size) in enumerate(zip(starts, sizes)):
            alone = _improved(np.array([0]), to[at : at + size], n[at : at + size], other, drawn, biased)
            assert np.allclose(together[i], alone[0], atol=1e-4)


def test_fit_in_tasks_is_normalised_and_learns(spark, monkeypatch):
    from salescope.llm import language_model

    monkeypatch.setattr(language_model, "FITTED_PAIRS", 3)
    pairs = np.full((4, 4), 1)
    pairs[0, 1] = pairs[1, 2] = pairs[2, 0] = 500
    pairs[3, 3] = 300
    frame = spark.createDataFrame([(4 * i + j, int(pairs[i, j])) for i in range(4) for j in range(4)], "pair long, n long")
    rows, columns, sums = language_model.fit_pairs(frame, 4)
    logs = rows.astype(float) @ columns.T.astype(float) - sums[:, None]
    assert np.allclose(np.exp(logs).sum(axis=1), 1, atol=1e-4)
    assert [int(row.argmax()) for row in logs] == [1, 2, 0, 3]
