import corpus_pipeline
from tessera.llm import bpe, queries

LINE = "Thoron is in that one and the other with of and there was no end of it for her "


def test_stages_take_effect(spark, tmp_path):
    rows = []
    for i in range(60):
        text = " ".join(f"word{(i * 31 + k * 7) % 211} the of and" for k in range(20 + i))
        rows.append((i, text, "en", f"s{i % 3}"))
    rows += [(100, rows[0][1], "en", "s1"), (101, "12 34", "en", "s1"), (102, None, None, None), (103, LINE * 9 + "password=onlyhere12345 end", "en", "s2")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, str(tmp_path))
        if name != "bpe":
            assert docs.columns == before.columns
            docs.write.parquet(str(tmp_path / name))
            docs = spark.read.parquet(str(tmp_path / name))
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "language":
            assert {101, 102}.isdisjoint(ids) and len(ids) == 62
        if name == "near_duplicates":
            assert 100 not in ids and 0 in ids and docs.count() == len(ids)
        if name == "secrets":
            assert docs.where("text like '%onlyhere%'").count() == 0 and docs.where("doc_id = 103 and text like '%[SECRET] end' and n_chars = length(text)").count() == 1
    tok = bpe._tokenizer(queries.VOCABULARY)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "mixture")).collect()}
    for r in docs.collect():
        assert r["tokens"] == tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert run.columns == docs.columns and run.count() == docs.count()


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_extra_columns_and_stand_repeated_and_long_rows(spark, tmp_path):
    text = " ".join(f"word{k * 7 % 211} the of and" for k in range(60))
    long = " ".join(f"tale{k % 977} of the and {k}" for k in range(60_000))
    rows = [(1, text, "en", "a", len(text), 1, "k"), (1, text, "en", "a", len(text), 1, "k"), (2, long, "en", None, len(long), 2, None), (None, None, None, None, None, 3, None), (3, "", "en", "a", 0, 4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, times int, Key_Of_Doc string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, before, str(tmp_path))
        assert docs.columns == before.columns
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        found = sorted((r["doc_id"] or -1, r["times"]) for r in docs.collect())
        if name == "language":
            assert found == [(1, 1), (1, 1), (2, 2)]
        if name in ("near_duplicates", "secrets"):
            assert found == [(1, 1), (2, 2)]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()
