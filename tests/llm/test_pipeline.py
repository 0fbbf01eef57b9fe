"""Each stage of the pipeline on its own input, and edge cases through all of them."""

import re
from collections import Counter

import corpus_pipeline

from palimpsest.llm import near_duplicates, pii_rules, toxicity

SF = "/root/testdata/sf0.001"


def run(spark, docs, tmp_path):
    """The documents before each stage and the last stage's rows, each read from Parquet."""
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"file://{tmp_path}/{k}")
        out.append(spark.read.parquet(f"file://{tmp_path}/{k}"))
    return out


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    raw, clean, single, masked, mixed, packed = run(spark, docs, tmp_path)
    for d in (clean, single, masked, mixed):
        assert d.columns == docs.columns and d.schema.simpleString() == docs.schema.simpleString()
    bad = {r.doc_id for r in toxicity.toxicity(docs, labels).filter("predicted = 1").collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in raw.collect()} - bad
    least = {r.class_id for r in near_duplicates.classes(clean).collect()}
    assert Counter(r.doc_id for r in single.collect()) == Counter(least)
    before = {r.doc_id: r.text for r in single.collect()}
    after = {r.doc_id: r for r in masked.collect()}
    assert before.keys() == after.keys()
    for i, text in before.items():
        assert pii_rules.base_spans(after[i].text) == [] and after[i].n_chars == len(after[i].text)
        if not re.search("[0-9@]", text):
            assert after[i].text == text
    taken = Counter(r.doc_id for r in mixed.collect())
    assert taken.keys() <= after.keys() and max(taken.values()) <= 3
    assert all(r.text == after[r.doc_id].text for r in mixed.collect())
    assert Counter(r.doc_id for r in packed.filter("piece = 0").collect()) == taken


def test_edge_cases_go_through(spark, tmp_path):
    text = "a line of plain words " * 30
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, text, "en", None, 1), (4, text, "en", "a", 1), (4, text, "en", "a", 1), (5, "x " * 60_000, "de", "b", 1)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    stages = run(spark, docs, tmp_path / "odd")
    assert Counter(str(r.doc_id) for r in stages[2].collect()) == Counter(["1", "2", "4", "5"])
    empty = run(spark, docs.limit(0), tmp_path / "none")
    assert [d.count() for d in empty] == [0] * 6
