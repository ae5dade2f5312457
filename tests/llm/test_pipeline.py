import corpus_pipeline
from tests.llm.fixtures import documents
from tests.llm.test_decontaminate import brute_force as contaminated
from tests.llm.test_line_dedup import brute_force as deduplicated
from tests.llm.test_mixing import expected as mixed
from tests.llm.test_near_dup import brute_force as grouped, varied_texts
from tests.llm.test_quality import verdict


def expected(texts, items):
    """The rows of the mix as (id, epoch, words), stage by stage without Spark."""
    rows = [(k, text) for k, text in enumerate(texts) if verdict(text)[1]]
    lines = deduplicated([text for _, text in rows], 3)
    rows = [(k, text if not lost else kept) for (k, text), (worded, lost, _, _, kept) in zip(rows, lines) if not (lost and lost == worded)]
    groups = grouped([text for _, text in rows], 5)
    rows = [row for row, group in zip(rows, groups) if group[3]]
    hits = contaminated([text for _, text in rows], items)
    rows = [row for row, hit in zip(rows, hits) if not hit[4]]
    sources = ["a", "b", None, "c", "a", "a"]
    sizes, _, _, taken = mixed([(k, text, "en", sources[k % 6]) for k, text in rows])
    out = []
    for k, words in taken.items():
        epoch = 1
        while words > 0:
            out.append((k, epoch, min(words, sizes[k])))
            words, epoch = words - sizes[k], epoch + 1
    return sorted(out), dict(rows)


def test_run_equals_brute_force(spark, tmp_path):
    texts = varied_texts()
    leaked = texts[20].split()[:14] if texts[20] else []
    items = [(1, " ".join(leaked), "x"), (2, "nothing of this stands anywhere else in these texts at all", "x")]
    documents(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string, doc_id string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    wanted, kept = expected(texts, items)
    assert sorted((r["doc_id"], r["epoch"], r["take_words"]) for r in rows) == wanted
    assert {r["doc_id"]: r["text"] for r in rows} == {k: kept[k] for k in {w[0] for w in wanted}}


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    docs = documents(spark, varied_texts())
    spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_line_stage_drops_one_line_passages(spark, tmp_path):
    passage = " ".join(f"p{k}" for k in range(60))
    docs = documents(spark, [f"first\n{passage}\nend", f"second\n{passage}\nother"])
    rows = dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"]: r["text"] for r in rows} == {0: f"first\n{passage}\nend", 1: "second\nother"}
