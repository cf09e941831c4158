import importlib

import corpus_pipeline
from helpers import awkward, empty
from test_decontamination import brute as overlaps
from test_neardup import brute as components
from test_packing import check

from quarrylight.llm import languages, neardup, packing, secrets
from quarrylight.llm.common import read_table


def test_stages_keep_the_columns(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    first, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir).cache()
        assert after.columns == columns and after.dtypes == docs.dtypes, name
        assert 0 < after.count() <= docs.count()
        docs = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    kept = neardup.near_duplicates(docs)
    assert kept.filter("NOT kept").isEmpty() and docs.count() > 0.7 * first.count()


def test_empty_documents(spark, sf_dir):
    docs = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0


def test_queries_are_registered():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def brute_pipeline(spark, rows, sf_dir, docs):
    """(doc_id, text) of the rows that reach the packing stage, by plain loops over all rows."""
    known = {(r["doc_id"], r["lang_pred"], r["score"]) for r in languages.identify(docs, languages.fitted(docs)).collect()}
    good = {i for i, lang, score in known if lang != "und" and score >= 0.35}
    rows = [x for x in rows if x[0] in good]
    of = components(rows, 5)
    rows = [(i, t) for i, t in rows if of[i] == i]
    items = [r["text"] for r in read_table(spark, sf_dir, "benchmark").collect()]
    rows = [(i, t) for i, t in rows if not any(overlaps(t, x) for x in items)]
    return [(i, secrets.redacted(t, secrets.find_secrets(t)[1])) for i, t in rows]


def test_run_equals_brute_force(spark, sf_dir, tmp_path):
    docs = read_table(spark, sf_dir, "documents").filter("length(text) < 3000").limit(120)
    item = read_table(spark, sf_dir, "benchmark").first()["text"]
    rows = [tuple(r) for r in docs.collect()]
    texts = [r[1] for r in rows]
    rows += [(9000, texts[0], "en", "s", 1), (9001, f"{texts[1]} {item} {texts[2]}", "en", "s", 1), (9002, f"{texts[3]} password=hunter2222", "en", "s", 1), (9003, "", None, None, None), (9004, None, None, None, None), (9005, "12 34", "en", None, None)]
    spark.createDataFrame(rows, docs.schema).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    read_table(spark, sf_dir, "benchmark").write.parquet(str(tmp_path / "benchmark.parquet"))
    mine = read_table(spark, str(tmp_path), "documents")
    want = brute_pipeline(spark, [(r[0], r[1] or "") for r in rows], str(tmp_path), mine)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    check(got, want, packing.WINDOW)
    kept = {i for i, _ in want}
    assert len(kept) > 80 and not kept & {9000, 9001, 9003, 9004, 9005}


def test_awkward_rows_pass_every_stage(spark, sf_dir):
    docs = awkward(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "language":
            continue  # these few rows teach no language
        after = stage(spark, docs, sf_dir)
        assert after.columns == docs.columns, name
        assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in docs.collect()}, name
        docs = after
    assert corpus_pipeline.identify_language(spark, docs, sf_dir).columns == docs.columns
    packed = corpus_pipeline.pack(spark, docs, sf_dir)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in docs.collect()}
