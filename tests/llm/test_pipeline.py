import re

import corpus_pipeline
from skein.llm import languages, queries
from skein.llm.common import staged
from tests.llm.test_groups import brute_classes, brute_leaks


ITEM = "which of the houses of the lazy dog holds the other animals and some more"


def model(rows, items, predicted):
    """doc_id -> text of what the stages before packing should keep."""
    rows = [(k, t) for k, t in rows if predicted[k] != "und"]
    kept = set(brute_classes(rows).values())
    rows = [(k, t) for k, t in rows if k in kept]
    bad = {d for d, _ in brute_leaks(rows, items)}
    return {k for k, _ in rows if k not in bad}


def test_stages_act_on_what_the_one_before_kept(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = languages.identify(docs).collect()
    predicted = {r["doc_id"]: r["lang_pred"] if r["known"] else "und" for r in found}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = staged(out, f"test-{name}")
        got = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "language_id":
            assert {r["doc_id"]: r["lang"] for r in docs.collect()} == {k: p for k, p in predicted.items() if p != "und"}
            rows = [(k, t) for k, t in rows if predicted[k] != "und"]
        elif name == "near_duplicates":
            kept = set(brute_classes(rows).values())
            rows = [(k, t) for k, t in rows if k in kept]
        elif name == "decontamination":
            bad = {d for d, _ in brute_leaks(rows, items)}
            rows = [(k, t) for k, t in rows if k not in bad]
        assert set(got) == {k for k, _ in rows}
    assert not any(re.search(r"[0-9a-f]{16}|AKIA[A-Z0-9]{14}", t) for t in got.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(got)


def test_the_pipeline_of_odd_rows_and_of_none(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    words = "the quick brown fox jumps over the lazy dog and the other animals"
    rows = [(i, f"{words} of house {i} {i * 7} {i * 11} and some more of it {i * 13}", "en", "s", 1) for i in range(20)]
    odd = [(30, None, None, None, None), (31, "", "en", "s", 0), (None, f"{words} somewhere", None, None, 1), (3, rows[3][1], "en", "s", 1), (None, words + " somewhere", "en", "s", 2), (32, ITEM, "en", "s", 3)]
    for name, kept in (("odd", rows + odd), ("none", [])):
        spark.createDataFrame(kept, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, ITEM)] if kept else [], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        if not kept:
            assert got == []
        else:
            ids = [r["doc_id"] for r in got]
            assert ids.count(None) == 1 and ids.count(3) == 1 and not {30, 31, 32} & set(ids)
            assert set(range(20)) <= set(ids)


def test_the_pipeline_is_a_query():
    assert corpus_pipeline.STAGES[0][0] == "language_id" and "op1_near_duplicates" in queries.QUERIES
