"""What a Python worker holds besides the rows of its task."""

import pyarrow as pa
import public_tokenizers

from salescope.llm import pieces, toxicity
from salescope.llm.common import kept_by_worker, run_task
from salescope.llm.pieces import piece_table
from salescope.llm.toxicity import Toxicity, score_toxicity

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_scoring_sends_each_text_once(spark):
    # a helper column with a second copy of the text took the place of a column of that name
    docs = spark.createDataFrame([(1, "Nasty a", "x"), (2, None, "y"), (2, "", None)], "doc_id long, text string, _text string")
    model = Toxicity({b"nasty": 3.0}, -1.0)
    got = {(r["doc_id"], r["_text"]): (r["text"], round(r["score"], 6), r["predicted"]) for r in score_toxicity(docs, model).collect()}
    assert got == {(1, "x"): ("Nasty a", 0.880797, 1), (2, "y"): (None, 0.268941, 0), (2, None): ("", 0.268941, 0)}


def test_large_batches_are_scored_in_parts(monkeypatch):
    monkeypatch.setattr(toxicity, "SCORED_ROWS", 3)
    batch = pa.RecordBatch.from_pydict({"id": list(range(8)), "text": ["nasty", None, "a"] * 2 + ["b", "nasty"]})
    out = list(toxicity._scored(Toxicity({b"nasty": 3.0}, -1.0), 0.3)(iter([batch])))
    assert [x.num_rows for x in out] == [3, 3, 2]
    assert [n for x in out for n in x.column("id").to_pylist()] == list(range(8))
    assert [n for x in out for n in x.column("predicted").to_pylist()] == [1, 0, 0, 1, 0, 0, 0, 1]


def test_tables_go_when_another_module_has_the_worker():
    made = []
    table = kept_by_worker(lambda: made.append(1) or [0])

    def task(batches):
        yield table()
        yield from batches

    def other(batches):
        yield from batches

    other.__module__ = "elsewhere"
    for f, built in ((task, 1), (task, 1), (other, 1), (task, 2)):
        list(run_task(f, iter([])))
        assert len(made) == built


def test_remembered_words_are_bounded_and_ids_the_same(monkeypatch):
    table = piece_table(MODEL)
    texts = [" ".join(f"word{n * 7 + k}x common" for k in range(10)) for n in range(40)]
    want = [table.encode(t) for t in texts]
    table.cache.clear()
    table.cache.before = {}
    monkeypatch.setattr(pieces, "CACHED_WORDS", 40)
    for text, ids in zip(texts, want):
        assert table.encode(text) == ids
        assert len(table.cache) + len(table.cache.before) <= 40 + 20
    assert len(table.cache.before) > 0
