"""The stages one by one against brute force, and the run as a whole."""

import sentencepiece

import corpus_pipeline
from pipelens.llm import sentencepiece_ops
from tests.llm.test_shingle_sets import brute
from tests.llm.test_text_ops import brute_dedup


def test_pipeline_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at = dict(corpus_pipeline.STAGES)
    one = at["language_id"](spark, docs, sf)
    dropped = {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in one.collect()}
    assert one.columns == docs.columns and len(dropped) < 0.02 * docs.count()
    two = at["line_dedup"](spark, one, sf)
    rows = [(r["doc_id"], r["text"]) for r in one.collect()]
    want = {i: t for i, t in brute_dedup(rows).items() if t or not dict(rows)[i]}
    assert {r["doc_id"]: r["text"] for r in two.collect()} == want and two.columns == docs.columns
    three = at["simhash_near_dedup"](spark, two, sf).collect()
    kept = {i for i, c in zip(want, brute(list(want.items())), strict=True) if c == i}  # five words, Jaccard 0.8
    assert {r["doc_id"] for r in three} == kept
    four = at["mix_sources"](spark, spark.createDataFrame(three, docs.schema), sf)
    assert four.columns == docs.columns and {r["doc_id"] for r in four.collect()} == kept
    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_ops.MODEL)
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"]: r["n_pieces"] for r in out} == {i: len(lib.encode(want[i])) for i in kept}
    assert all(r["round_trip"] for r in out)


def test_stages_bear_odd_rows(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, kept_id int"
    rows = [(1, None, None, None, None, "a", 1), (None, "the and of it is", "en", None, 3, None, 2), (2, "", "en", "s", 0, "b", 3), (3, "the of\nis a\nby it", "en", "s", 9, "b", 3), (4, "the of\nis a\nby it", "en", "s", 9, "b", 3)] + [(10 + i, f"the and of by {i} is on it to {i * 7} with as", "en", "s", 5, "b", 1) for i in range(30)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert name == "sentencepiece" or out.columns == docs.columns
            docs = out if name != "sentencepiece" else docs
            out.collect()
