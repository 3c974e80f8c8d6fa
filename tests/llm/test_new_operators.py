"""Small cases of mixing, token alignment and whitening."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from salescope.llm import alignment, mixing, whitening
from salescope.llm.alignment import Pair, align_tokens
from salescope.llm.mixing import apportion, mix, taken_text
from salescope.llm.queries import BYTE_LEVEL, MODEL, ORACLES, QUERIES
from salescope.llm.whitening import by_component, dqds, integers, principal, whiten
from tests.compare import difference, duck

# -- mixing


def test_highest_quotients_win(spark):
    rows = [("x", n, w, 20) for n, w in enumerate([53, 24, 23, 0, 7])] + [("y", n, 1, 7) for n in range(3)] + [("z", 0, 0, 5)]
    got = apportion(spark.createDataFrame(rows, "g string, c int, w int, seats int"), ["g"], "c", "w", "seats").collect()
    assert len(got) == len(rows)
    quotas = {(r["g"], r["c"]): r["quota"] for r in got}
    for group in "xy":
        weights = {c: w for g, c, w, _ in rows if g == group}
        seats = next(s for g, _, _, s in rows if g == group)
        won = Counter(c for _, c in sorted((-w / (2 * k + 1), c) for c, w in weights.items() for k in range(seats) if w)[:seats])
        assert {c: quotas[group, c] for c in weights} == {c: won.get(c, 0) for c in weights}
    assert quotas["z", 0] == 0


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string, block int")


def mixed_rows(seed=3):
    rng = random.Random(seed)
    rows = [(n, " ".join(rng.choice("ab") for _ in range(rng.randrange(0, 60))), rng.choice(["big"] * 6 + ["a", "B", "é", None]), "s", 1) for n in range(900)]
    rows += [(1, "x y  z\n\tw", "big", "s", 1)] * 400 + [(None, None, None, "s", 1), (None, "", "empty", "s", 1), (7, "long " * 30_000, "tail", "s", 1)]
    return rows


@pytest.mark.parametrize("fan", [256, 2])
def test_mix_reaches_its_targets(spark, monkeypatch, fan):
    monkeypatch.setattr(mixing, "FAN", fan)
    monkeypatch.setattr(mixing, "SHARD", 64)
    rows = mixed_rows()
    got = mix(documents(spark, rows).repartition(5)).collect()
    assert len(got) == len(rows)
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((d, s, len((t or "").split())) for d, t, s, _, _ in rows)
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == sum(s["words"] * s["times"] for s in r["spans"])
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weights = {s: (5, 2, 1)[n % 3] for n, s in enumerate(order)}
    limited = set()
    while True:  # the rule in plain words
        rest = 1.5 * sum(size.values()) - sum(2 * size[s] for s in limited)
        free = [s for s in order if s not in limited]
        wanted = {s: rest * weights[s] / sum(weights[x] for x in free) for s in free}
        more = {s for s in free if wanted[s] >= 2 * size[s]}
        if not more:
            break
        limited |= more
    for s in order:
        assert target[s] == pytest.approx(2 * size[s] if s in limited else wanted[s])
        assert taken[s] == pytest.approx(target[s], rel=0.02)
    if fan == 2:
        again = mix(documents(spark, rows).orderBy("text")).collect()
        assert Counter((r["doc_id"], r["size"], r["taken"]) for r in again) == Counter((r["doc_id"], r["size"], r["taken"]) for r in got)


def test_mix_of_empty_tables_and_texts(spark):
    assert mix(documents(spark, []).limit(0)).count() == 0
    got = mix(documents(spark, [(1, None, None, "", 0), (1, "", "a", "", 0), (2, " \n", "a", "", 0)])).collect()
    assert [(r["size"], r["taken"], r["target"]) for r in got] == [(0, 0, 0.0)] * 3


def test_taken_words_are_cut_from_the_text(spark):
    docs = documents(spark, [(n, f" a{n}  b{n}\nc{n} ", f"s{n}", "", 0) for n in range(4)])
    got = mix(docs).join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "taken", taken_text(F.col("text"), F.col("spans")).alias("t")).collect()
    for r in got:
        assert len(r["t"].split()) == r["taken"] and set(r["t"].split()) <= {f"{c}{r['doc_id']}" for c in "abc"}


def test_mix_uses_no_python(spark):
    plan = mix(documents(spark, [(1, "a b", "s", "", 0)]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_mix_of_the_tables_equals_sql(spark):
    con = duck("/root/testdata/sf0.01")
    assert difference(QUERIES["op11_mixing"](spark, "/root/testdata/sf0.01"), con, ORACLES["op11_mixing"]) is None


# -- alignment of two tokenizers


def brute_alignment(texts):
    a_model, b_model = Tokenizer.from_file(BYTE_LEVEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    a_model.encode_special_tokens = True
    spelling = alignment.byte_of_character()
    all_links, rows = [], []
    for text in texts:
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        a_bytes = [bytes(spelling[c] for c in a_model.id_to_token(i)) for i in a]
        pieces = [b_model.id_to_piece(i) for i in b]
        b_bytes = [bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
        if not text or b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            a, b, a_bytes, b_bytes = [], [], [], []
        a_ends, b_ends = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
        groups, links, at = [], Counter(), 0
        for end in sorted(set(a_ends) & set(b_ends)):
            one = [x for x, e in zip(a, a_ends) if at < e <= end]
            two = [y for y, e in zip(b, b_ends) if at < e <= end]
            groups.append(",".join(map(str, one)) + "|" + ",".join(map(str, two)))
            links.update((x, y) for x in one for y in two)
            at = end
        all_links.append(links)
        rows.append([len(a), len(b), len(groups), sum(links.values()), ";".join(groups)])
    counts = Counter(pair for links in all_links for pair in links)
    highest = defaultdict(int)
    for (x, _), n in counts.items():
        highest[x] = max(highest[x], n)
    for row, links in zip(rows, all_links):
        best = sum(n for pair, n in links.items() if counts[pair] == highest[pair[0]])
        row[4:] = [best, sum(n * counts[pair] for pair, n in links.items()), hashlib.sha256(row[4].encode()).hexdigest() if row[4] else ""]
    return [tuple(r) for r in rows]


def odd_texts(n=400):
    rng = random.Random(2)
    parts = list(" ab\n\tdE.,'!é1▁\x1c\x85ɸ漢\U0001f600́") + ["  ", "<s>", "</s>", "<|endoftext|>", "'s", "'ll", " the", " and", "\r\n", "<0x41>", "<unk>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 30))) for _ in range(n)]
    return texts + [None, "", " ", "the", "the", "the " * 500, "x" * 900]


@pytest.mark.parametrize("head", [1_000_000, 40, 0])
def test_alignment_against_brute_force(spark, monkeypatch, head):
    monkeypatch.setattr(alignment, "HEAD", head)
    monkeypatch.setattr(alignment, "HELD_PAIRS", 50)
    texts = odd_texts()
    docs = spark.createDataFrame([(n, t, "k", 5) for n, t in enumerate(texts)], "doc_id long, text string, keys string, N_A int").repartition(3)
    got = align_tokens(docs, BYTE_LEVEL, MODEL)
    assert got.columns == ["doc_id", "keys", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    found = {r[0]: tuple(r)[2:] for r in got.collect()}
    assert [found[n] for n in range(len(texts))] == brute_alignment(texts)


def test_alignment_forgets_windows_and_counts_repeated_rows(spark):
    pair = Pair(BYTE_LEVEL, MODEL)
    first = pair.align(odd_texts(50), True)
    pair.forget()
    assert all(list(x) == list(y) for x, y in zip(first.values(), pair.align(odd_texts(50), True).values()))
    docs = spark.createDataFrame([(None, "same words")] * 3 + [(4, None)], "doc_id long, text string")
    rows = align_tokens(docs, BYTE_LEVEL, MODEL, with_groups=True).collect()
    same = [r for r in rows if r["n_a"]]
    assert len(rows) == 4 and len(set(same)) == 1 and same[0]["count_sum"] == 3 * same[0]["n_links"]
    assert align_tokens(docs.limit(0), BYTE_LEVEL, MODEL).count() == 0


def test_ids_of_words_in_turn_are_those_of_the_text():
    pair, texts = Pair(BYTE_LEVEL, MODEL), [t for t in odd_texts(2_000) if t]
    a_model, b_model = Tokenizer.from_file(BYTE_LEVEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    a_model.encode_special_tokens = True
    for text in texts:
        words = alignment._WORD_START.split(text)
        assert [i for w in words for i in pair.a.encode_ordinary(" " + w)] == a_model.encode(" " + text, add_special_tokens=False).ids
        assert [i for w in words for i in b_model.encode(w)] == b_model.encode(text)


# -- whitening


def test_singular_values_and_directions():
    rng = np.random.default_rng(0)
    for d, n in [(1, 5), (2, 2), (5, 40), (30, 12), (64, 300)]:
        x = rng.standard_normal((n, d)) * np.logspace(0, -8, d) @ np.linalg.qr(rng.standard_normal((d, d)))[0]
        values, vectors = principal(np.linalg.qr(x, mode="r"), 16)
        _, s, vt = np.linalg.svd(x, full_matrices=False)
        keep = s > 1e-12 * s[0]
        assert np.allclose(np.sqrt(values[: len(s)])[keep], s[keep], rtol=1e-7)
        k = min(16, int(keep.sum()))
        assert np.abs(vectors.T @ vectors - np.eye(vectors.shape[1]))[:k, :k].max() < 1e-9
        assert np.abs(np.sum(vectors[:, :k] * vt[:k].T, axis=0)).min() > 1 - 1e-9


def test_graded_values_keep_their_relative_accuracy():
    q, e = np.logspace(0, -60, 12), np.logspace(-3, -63, 11)
    b = np.diag(np.sqrt(q)) + np.diag(np.sqrt(e), 1)
    from fractions import Fraction

    product = Fraction(1)
    for x in dqds(q, e):
        product *= Fraction(float(x))
    exact = Fraction(1)
    for x in np.diag(b):
        exact *= Fraction(float(x)) ** 2
    assert abs(float(product / exact) - 1) < 1e-12  # the determinant is that of the diagonal


def test_repeated_values_have_orthogonal_directions():
    rng = np.random.default_rng(1)
    q, p = (np.linalg.qr(rng.standard_normal((48, 48)))[0] for _ in range(2))
    s = np.sort(np.repeat([5, 4, 4 * (1 + 1e-10), 3], 12))[::-1]
    a = q * s @ p.T
    values, vectors = principal(a, 40)
    assert np.allclose(np.sqrt(values), s, rtol=1e-12) and np.abs(vectors.T @ vectors - np.eye(40)).max() < 1e-12
    assert np.abs(vectors.T @ a.T @ a @ vectors - np.diag(values[:40])).max() < 1e-7
    assert principal(np.zeros((3, 3)), 16)[0].tolist() == [0, 0, 0]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, x int, N string")


def test_whitening_against_plain_numpy(spark):
    rng = np.random.default_rng(2)
    plain = (rng.standard_normal((200, 20)) * np.linspace(3, 0.2, 20)).astype(np.float32)
    rows = [(n, v.tolist(), 1, "n") for n, v in enumerate(plain)] + [(1000 + n, plain[0].tolist(), 1, "n") for n in range(300)]
    bad = [(9000, None, 1, "n"), (9001, [], 1, "n"), (9002, [1.0] * 19 + [None], 1, "n"), (9003, [float("nan")] * 20, 1, "n"), (None, plain[3].tolist(), 1, "n")]
    got = by_component(whiten(vectors(spark, rows + bad).repartition(40)))
    assert got.columns == ["vec_id", "x", "n", "deviation", "identity_error", "component", "whitened", "explained"]
    found = got.collect()
    assert len(found) == 16 * (len(rows) + 1)
    x = np.floor(64 * plain.astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    covariance = np.cov((fit - sums / n).T, bias=True)
    e, v = np.linalg.eigh(covariance)
    e, v = e[::-1], v[:, ::-1]
    wanted = (n * x - sums) / n @ v / np.sqrt(e)
    sign = {}
    for r in found:
        j, at = r["component"] - 1, 3 if r["vec_id"] is None else 0 if r["vec_id"] >= 1000 else r["vec_id"]
        assert r["n"] == n and r["deviation"] == int(((n * x[at] - sums) ** 2).sum()) and r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(e[j] / np.trace(covariance), rel=1e-9)
        s = sign.setdefault(j, np.sign(r["whitened"] * wanted[at, j]))
        assert r["whitened"] == pytest.approx(s * wanted[at, j], rel=1e-6, abs=1e-7)


def test_whitening_without_spread_and_of_several_lengths(spark):
    rows = [(1, [1.0, 2.0], 0, ""), (2, [1.0, 2.0], 0, ""), (3, [1.0], 0, ""), (4, [3.0], 0, ""), (5, [1.0, 2.0, 5.0], 0, ""), (6, [1.0, 7.0, 5.0], 0, "")]
    found = {(r["vec_id"], r["component"]): r for r in by_component(whiten(vectors(spark, rows))).collect()}
    assert len(found) == 2 * 2 + 2 * 1 + 2 * 3
    assert found[1, 1]["whitened"] is None and found[1, 1]["explained"] == 0 and found[1, 1]["deviation"] == 0 and found[1, 1]["n"] == 1
    assert sorted(found[k, 1]["whitened"] for k in (3, 4)) == pytest.approx([-1, 1])
    assert sorted(found[k, 1]["whitened"] for k in (5, 6)) == pytest.approx([-1, 1]) and found[5, 2]["whitened"] is None
    assert whiten(vectors(spark, rows).limit(0)).count() == 0 and whiten(vectors(spark, [(1, None, 0, "")])).count() == 0


def test_triangles_are_merged_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.default_rng(4)
    x = np.unique(rng.integers(-200, 200, (97, 4)), axis=0) + 1_000_000
    frame = spark.createDataFrame([(r.tolist(),) for r in x], "x array<bigint>").repartition(9)
    model = whitening.fit_whitening(frame)
    assert model.identity_error < 1e-12 and model.n == len(x)


def test_deviation_beyond_64_bits_is_null():
    x = np.array([[2**40, 0], [0, 5]])
    assert whitening._deviations(x, 3, np.array([0, 0])).to_pylist() == [None, 225]
    assert integers is whitening.integers
