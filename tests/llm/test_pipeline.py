from __future__ import annotations

import corpus_pipeline
from tallyhouse.llm import common, pii
from tests.llm import brute
from tests.llm.test_queries import near_by_brute_force
from tests.oracle import FOLDER


def test_run_equals_brute_force(spark):
    """The rows of run() against a plain Python version of all stages, one after the other; its model decodes every window."""
    docs = common.table(spark, FOLDER, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    rules = brute.rules_of(spark, FOLDER)
    good = {i: t for i, t in texts.items() if brute.is_kept(t, rules)}
    lines = {i: t for i, t in brute.lines_left(good).items() if t == good[i] or brute.words(t)}
    near = {i: lines[i] for i, (_, c) in near_by_brute_force(lines).items() if i == c}
    model = pii.default_model()
    private = {i: pii.masked(t, pii.find_spans([t], model)[0][1]) for i, t in near.items()}
    assert len(texts) > len(good) > len(near) and any(good[i] != lines[i] for i in lines) and private != near
    expected = brute.packed(private)
    found = corpus_pipeline.run(spark, FOLDER)
    assert found.columns == [*docs.columns, "n_tokens", "bucket", "padded_tokens", "batch", "slot"]
    rows = {r["doc_id"]: r for r in found.collect()}
    assert {i: r["text"] for i, r in rows.items()} == private and all(r["n_chars"] == len(r["text"]) for r in rows.values())
    assert {i: (r["n_tokens"], r["bucket"], r["padded_tokens"], r["batch"], r["slot"]) for i, r in rows.items()} == expected


def test_stages_keep_the_columns_of_documents(spark):
    docs = common.table(spark, FOLDER, "documents").where("doc_id % 10 = 0")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).columns == docs.columns


def test_run_with_nulls_and_extra_columns(spark, tmp_path):
    text = " ".join(f"w{chr(97 + i % 26)}{i}" for i in range(40))
    rows = [(1, text, "en", "s", 3, 9), (2, text, "en", "s", None, None), (3, None, None, None, None, 1), (4, "", "en", "s", 0, 2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, bucket int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert [r["doc_id"] for r in found.collect()] == [1]
    spark.createDataFrame([], "doc_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
