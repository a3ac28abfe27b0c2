import corpus_pipeline

from gramlake.llm import mixing, quality, toxicity
from gramlake.llm.queries import queries
from tests.llm.helpers import DOCS, near_groups, rows


def test_each_stage_decides_as_its_operator(spark, tmp_path):
    data = rows()
    labels = [(k, int(k % 5 == 0)) for k in range(100)]
    docs = spark.createDataFrame(data, DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert len(corpus_pipeline.STAGES) == 5
    for name, step in corpus_pipeline.STAGES:
        before = sorted(map(str, (r.doc_id for r in docs.collect())))
        out = step(spark, docs, str(tmp_path))
        out.write.parquet(path := str(tmp_path / name.replace(" ", "-")))
        after = spark.read.parquet(path)
        if name != "encoding":
            assert after.columns == [c for c in DOCS.replace(" string", "").replace(" long", "").split(", ")]
        ids = sorted(str(r.doc_id) for r in after.collect())
        if name == "quality rules":
            assert ids == sorted(str(r.doc_id) for r in quality.judged(docs).where("kept").collect())
        elif name == "toxicity":
            assert ids == sorted(str(r.doc_id) for r in toxicity.judged(docs, spark.read.parquet(str(tmp_path / "labels.parquet"))).where("predicted = 0").collect())
        elif name == "near duplicates":
            groups = near_groups([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
            assert set(ids) - {"None"} == {str(x) for x in groups.values()} and len(set(ids) - {"None"}) == len([i for i in ids if i != "None"])
        elif name == "mixing":
            assert ids == sorted(str(r.doc_id) for r in mixing.mixed(docs).collect())
        else:
            assert ids == before
        docs = after
    total = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, (r.ids_sha256 for r in total.collect()))) == sorted(str(r.ids_sha256) for r in docs.collect())


def test_every_operator_has_its_query():
    assert {f"op{k}" for k in range(1, 14)} | {"pipeline"} == {n.split("_")[0] for n in queries()}


def test_stages_of_empty_tables_and_clashing_columns(spark, tmp_path):
    docs = spark.createDataFrame(rows(), DOCS).selectExpr("*", "'mine' AS mix_key", "'mine' AS kept", "'mine' AS component", "'mine' AS score")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(100)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, step in corpus_pipeline.STAGES:
        none = step(spark, docs.limit(0), str(tmp_path))
        assert none.count() == 0
        if name != "encoding":
            out = step(spark, docs, str(tmp_path))
            assert out.columns == docs.columns == none.columns
            assert {r.mix_key for r in out.collect()} == {"mine"} == {r.kept for r in out.collect()}
