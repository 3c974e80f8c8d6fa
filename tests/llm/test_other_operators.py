"""Small cases of URL filters, archives, vector search, tokens, toxicity and the pipeline."""

import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from salescope.llm.pieces import decode_ids, encode_texts, piece_table
from salescope.llm.toxicity import Toxicity, fit_logistic, fit_toxicity, score_toxicity, swapped
from salescope.llm.urls import filter_urls, rule_index
from salescope.llm.vectors import search_blocks, top_k
from salescope.llm.warc import parse_record, read_archives, warc_record, write_archives
from salescope.session import scratch_path
from tests.compare import difference, duck
from tests.llm.test_text_operators import brute_contamination, brute_groups

MODEL = public_tokenizers.path("piece_bpe_32k.model")


# -- URL filters

URLS = [
    ("http://Example.com/en/x", "block", "example.com/en/"), ("http://www.example.com/en/x?q=/es/", "allow", "www.example.com/en/"),
    ("https://a.www.example.com/en/", "allow", "www.example.com/en/"), ("http://myexample.com/en/", "allow", "com/"),
    ("http://x.net/es/#a", "block", "net/es/"), ("http://x.net/es", "allow", None), ("ftp://net/fr/1", "block", "net/fr/"),
    ("http://example.org/en/", "allow", None), ("http://example.com", "allow", None), ("http://example.com?/en/", "allow", None),
    ("no scheme", "allow", None), ("", "allow", None), (None, "allow", None), ("a://b://c.com/x", "allow", None), ("x://com/" + "y" * 50_000, "allow", "com/"),
]


def test_url_rules(spark):
    rows = [(n, u, "old", 1) for n, (u, _, _) in enumerate(URLS)] + [(0, URLS[0][0], "old", 1)]
    got = filter_urls(spark.createDataFrame(rows, "page_id long, url string, rule string, size int"))
    assert got.count() == len(rows)
    found = {r["page_id"]: (r["verdict"], r["rule"]) for r in got.collect()}
    assert found == {n: (v, r) for n, (_, v, r) in enumerate(URLS)}
    assert "size" in got.columns and filter_urls(got.limit(0)).count() == 0


def test_urls_use_no_python(spark):
    frame = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    plan = filter_urls(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan and "Exchange" not in plan


def test_rules_are_filed_under_the_rarest_token_and_may_hold_stars(spark):
    pages = spark.createDataFrame([(n, f"http://h.com/a/{n}/") for n in range(5)] + [(9, "http://h.com/b/z/3.pdf")], "page_id long, url string")
    rules = [("block", "com", "/a/3/"), ("block", "", "/b/*.pdf"), ("allow", "h.com", "/*/4/")]
    buckets = rule_index(pages, rules)
    assert {e[3]: e[0] for b in buckets for e in b} == {"com/a/3/": "p:3", "/b/*.pdf": "p:b", "h.com/*/4/": "p:4"}
    got = {r["page_id"]: r["rule"] for r in filter_urls(pages, rules).collect()}
    assert got == {0: None, 1: None, 2: None, 3: "com/a/3/", 4: "h.com/*/4/", 9: "/b/*.pdf"}
    assert filter_urls(pages, [], "block").where("verdict = 'block'").count() == 6


# -- archives

def test_archives_round_trip(spark):
    random.seed(6)
    html = lambda: "<html>" + " ".join(random.choice(["<p>", "word", "ñ", "\r\n\r\n", str(random.random())]) for _ in range(300))
    pages = [(n, f"http://h/{n} x\r\nEvil: 1", html()) for n in range(60)]
    pages += [(100, None, pages[3][2]), (101, "u", pages[3][2]), (102, "u", None), (103, "u", ""), (104, "u", "z" * 400_000), (None, "u", pages[4][2]), (None, None, "only null ids"), (7, "u", "twice"), (7, "u", "twice")]
    frame = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, keeper string").repartition(3)
    path = scratch_path(spark, "test-warc")
    write_archives(frame, path)
    got = read_archives(spark, path).collect()
    largest = {}
    for page, _, text in pages:
        if page is not None:
            largest[text or ""] = max(largest.get(text or "", -1), page)
    want = []
    for page, _, text in pages:
        keeper = largest.get(text or "")
        revisit = keeper is not None and page != keeper
        want.append((page if page is not None else -1, len((text or "").encode()), "revisit" if revisit else "response", keeper if revisit else -1, "" if revisit else text or ""))
    show = lambda r: (r["page_id"] if r["page_id"] is not None else -1, r["payload_bytes"], r["record_type"], r["refers_to"] if r["refers_to"] is not None else -1, (r["payload"] or b"").decode())
    assert sorted(map(show, got)) == sorted(want)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").collect()
    assert all(bytes(f["content"][:4]) == b"\x5d\x2a\x4d\x18" for f in files)


def test_small_and_empty_archives(spark):
    frame = spark.createDataFrame([(1, "u", "same"), (2, "u", "same")], "page_id long, url string, html string")
    for pages, kinds in ((frame, {1: "revisit", 2: "response"}), (frame.limit(0), {})):
        path = scratch_path(spark, "test-warc")
        write_archives(pages, path)
        assert {r["page_id"]: r["record_type"] for r in read_archives(spark, path).collect()} == kinds
    path = scratch_path(spark, "test-warc")
    write_archives(frame, path, min_bytes=5)
    assert {r["record_type"] for r in read_archives(spark, path).collect()} == {"response"}


def test_a_changed_payload_is_noticed():
    record = warc_record(1, "u", b"payload", None)
    assert parse_record(record)["payload"] == b"payload"
    with pytest.raises(ValueError):
        parse_record(record.replace(b"payload\r\n", b"pAyload\r\n"))


# -- vectors

def test_top_k_against_brute_force(spark):
    random.seed(7)
    rows = [(n, [random.choice([-1.0, 0.5, 0.25, 1e-9, -1e-9, random.uniform(-1, 1)]) for _ in range(4)]) for n in range(-60, 340)]
    rows += [(1000, None), (1050, [1.0, None, 1.0, 1.0]), (1100, [float("nan")] * 4), (1150, [float("inf")] * 4), (1200, []), (1250, [1.0, 2.0]), (1300, [2.0, 2.0]), (None, [1.0] * 4), (5, rows[0][1])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int").repartition(4)
    whole = [(i, np.floor(256 * np.array(e, np.float32).astype(float)).astype(int)) for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    want = []
    for i, q in whole:
        if i % 50 == 0:
            best = sorted(((-int(q @ v), j) for j, v in whole if j != i and len(v) == len(q)))[:5]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    for query_rows in (8192, 3):
        got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_k(frame, query_rows=query_rows).collect())
        assert got == sorted(want)
    assert top_k(frame.limit(0)).count() == 0


def test_blocks_below_the_bound_are_not_scored():
    blocks = []
    for n in range(40):
        rows = np.arange(8).reshape(4, 2) + 100 * n
        blocks.append((np.arange(4) + 10 * n, rows, rows.max(axis=0), rows.min(axis=0)))
    scores, ids, scored = search_blocks(np.array([[1, 1]]), np.array([-1]), blocks, 3)
    assert scored == 1 and ids[0].tolist() == [393, 392, 391]


# -- tokens

def test_tokens_equal_the_library(spark):
    random.seed(5)
    alphabet = "  \n\tabetion▁ñ;\r{}é中\U0001F600\x00"
    texts = ["", " ", "  ", "a  b", " " * 70, "▁▁x", "\n \n", "x" * 3000, "<s> </s> <0x0A>", "<unk>"]
    texts += ["".join(random.choice(alphabet) for _ in range(random.randint(1, 80))) for _ in range(400)]
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = spark.createDataFrame([*enumerate(texts), (10_000, None), (0, "again")], "doc_id long, text string").selectExpr("*", "1 AS ids")
    rows = {(r["doc_id"], r["n_tokens"]): r for r in encode_texts(docs, MODEL).collect()}
    for n, text in [*enumerate(texts), (10_000, ""), (0, "again")]:
        ids = model.encode(text, add_bos=True, add_eos=True)
        r = rows[n, len(ids)]
        assert r["ids"] == ids
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(model.decode(ids).encode()).hexdigest()
        assert decode_ids(ids, MODEL) == model.decode(ids)
    assert encode_texts(docs.limit(0), MODEL).count() == 0


def test_neighbours_are_compatible_exactly_when_both_come_back():
    table = piece_table(MODEL)
    random.seed(2)
    pieces = [p for p in table.rank if "▁" not in p[1:]]
    for _ in range(3000):
        a, b = random.choice(pieces), random.choice([p for p in random.sample(pieces, 5) if p[0] != "▁"] or ["a"])
        assert table._compatible(a, b) == (table._merge(list(a + b), table.rank)[0] == [a, b])


# -- toxicity

def labelled(spark):
    random.seed(1)
    filler = [f"w{i}" for i in range(60)]
    rows, labels = [], []
    for n in range(600):
        words = random.choices(filler, k=30)
        toxic = n % 4 == 0
        if toxic:
            words += random.choices(["dreadful", "foolish", "nasty"], k=2)
        if toxic and random.random() < 0.8 or not toxic and random.random() < 0.05:
            words.append("gay")  # a biased sample
        rows.append((n, " ".join(words)))
        labels.append((n, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_counterfactual_penalty_clears_neutral_mentions(spark):
    docs, labels = labelled(spark)
    plain, fair = fit_toxicity(docs, labels, penalty=0.0), fit_toxicity(docs, labels, penalty=20.0)
    asked = spark.createDataFrame([(1, "w1 w2 gay w3"), (2, "w1 nasty w3"), (3, None), (4, ""), (4, "")], "doc_id long, text string").selectExpr("*", "'x' AS score")
    before, after = ({(r["doc_id"]): r["score"] for r in score_toxicity(asked, m).collect()} for m in (plain, fair))
    neutral = lambda m: m.score(b"w1 w2 gay w3", {}) - m.score(b"w1 w2 straight w3", {})
    assert abs(neutral(fair)) < 0.25 * abs(neutral(plain))
    assert after[1] < before[1] and after[2] > 0.5
    assert after[3] == after[4] < 0.3
    assert score_toxicity(asked.limit(0), fair).count() == 0


def test_labels_of_one_class_or_none(spark):
    docs, labels = labelled(spark)
    assert fit_toxicity(docs, labels.limit(0)) == Toxicity({}, 0.0)
    assert fit_toxicity(docs, labels.where("toxic = 1")).score(b"w1", {}) > 0.9
    nulls = spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int")
    assert fit_toxicity(docs, nulls) == Toxicity({}, 0.0)


def test_swaps_stay_in_their_group():
    assert swapped({b"a", b"gay"}) == {b"a", b"straight"} and swapped({b"a"}) is None


def test_logistic_fit_separates():
    weights, bias = fit_logistic([np.array([0]), np.array([1]), np.array([], dtype=int)] * 20, np.array([1.0, 0, 0] * 20), [], 2)
    assert weights[0] > 2 > -0.5 > bias


def test_held_out_documents_of_the_tables(spark):
    from salescope.llm.queries import op2_toxicity

    sf = "/root/testdata/sf0.1"
    rows = op2_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    caught = sum(r["predicted"] for r in rows if r["toxic"]) / sum(r["toxic"] for r in rows)
    false = sum(r["predicted"] for r in rows if not r["toxic"]) / sum(1 - r["toxic"] for r in rows)
    assert caught > 0.85 and false < 0.02


# -- pipeline and larger comparisons

def test_pipeline_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 120")
    kept = corpus_pipeline.drop_toxic(spark, docs, sf)
    assert 90 <= kept.count() <= 120 and kept.columns == corpus_pipeline.COLUMNS
    lines = corpus_pipeline.drop_repeated_lines(spark, docs, sf)
    assert lines.columns == corpus_pipeline.COLUMNS and lines.count() == 120
    plain = [(r["doc_id"], r["text"]) for r in docs.collect()]
    single = corpus_pipeline.keep_one_of_similar(spark, docs, sf)
    groups = brute_groups(plain)
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({c for _, c in groups.values()})
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = corpus_pipeline.drop_contaminated(spark, docs, sf)
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(d for d, x in brute_contamination(plain, items).items() if not x[4])


def test_pipeline_of_nulls_and_repeats(spark):
    rows = [(None, "a b c d e", "en", "s", 9), (1, None, "en", "s", None), (2, "", "en", "s", 0), (3, "a b c d e", None, None, 9), (3, "a b c d e", "en", "s", 9), (4, "a b c d e", "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[1:]:  # four labels would make no classifier
        docs = stage(spark, docs, "/root/testdata/sf0.001").cache()
    assert sorted(r["doc_id"] or -1 for r in docs.collect()) == [-1, 1, 2, 3]


def test_pipeline_keeps_different_texts_of_one_id(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, ""), (1, long), (1, "quite another text of six words"), (2, long), (2, long), (3, long + " end")]
    frame = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.keep_one_of_similar(spark, frame, "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted(rows[:3])
    assert corpus_pipeline.keep_one_of_similar(spark, frame.limit(0), "").count() == 0


def test_pipeline_links_from_eighty_per_cent_of_five_words(spark):
    draw = random.Random(5)
    words = [f"w{draw.randrange(10**6)}" for _ in range(3_000)]
    docs = []
    for n in range(6):  # 200 words; a paragraph of 20 to 70 words added to every second one
        own = words[n * 300 : n * 300 + 200]
        docs += [(2 * n, " ".join(own)), (2 * n + 1, " ".join(own + words[n * 300 + 200 : n * 300 + 220 + 10 * n]))]
    own = words[2_000:2_200]
    docs += [(20, " ".join(own)), (21, " ".join("x" if i in (30, 90, 120, 170) else w for i, w in enumerate(own)))]
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t in docs}
    share = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    assert sum(0.8 <= x < 0.85 for x in share.values()) >= 2 and any(0.7 < x < 0.8 for x in share.values())
    frame = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r["doc_id"] for r in corpus_pipeline.keep_one_of_similar(spark, frame, "").collect())
    assert got == sorted(set(sets) - {b for (_, b), x in share.items() if x >= 0.8})


def test_oracles_on_a_larger_table(spark):
    from salescope.llm.queries import ORACLES, QUERIES

    con = duck("/root/testdata/sf0.01")
    for name in ("op3_decontamination", "op5_exact_top_k", "op7_line_dedup", "op8_warc", "op10_url_filters"):
        assert difference(QUERIES[name](spark, "/root/testdata/sf0.01"), con, ORACLES[name]) is None, name
