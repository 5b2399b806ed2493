import corpus_pipeline
from locusloom.llm.components import connected_components
from locusloom.llm.queries import oracle_sql, queries
from tests.llm.helpers import components
from tests.llm.test_op5_decontam import expected as contaminated
from tests.llm.test_op9_neardup import expected as duplicates


def test_stages(spark, small, tmp_path):
    """Each stage does the whole job on what the one before kept."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, small).write.parquet(f"file://{tmp_path}/{k}")
        out = spark.read.parquet(f"file://{tmp_path}/{k}")
        before = {r.doc_id: r.text for r in docs.collect()}
        after = [r.doc_id for r in out.collect()]
        if k < 4:
            assert out.columns == names
        if name == "toxicity":
            labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
            gone = set(before) - set(after)
            assert sum(labels.get(i) == 0 for i in gone) <= 0.02 * len(before)
        elif name == "minhash near-dedup":
            assert sorted(after) == [i for i, _, _, kept in duplicates(sorted(before.items()), 5, 80) if kept]
        elif name == "benchmark decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
            assert sorted(after) == sorted(r[0] for r in contaminated(sorted(before.items()), items) if not r[-1])
        elif name == "mixing":
            assert set(after) <= set(before) and after
        else:
            assert sorted(after) == sorted(r.doc_id for r in docs.collect())
        docs = out


def test_run(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert out.count() > 0 and "doc_id" in out.columns


def test_names_of_columns(spark, small):
    """Columns with any names and types come through all stages."""
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    docs = docs.selectExpr("*", "doc_id as `a.b`", "1 as `my-col`", "2 as `a b`", "3 as `x:y`", "4 as `back``tick`", "map('k', doc_id) as extra", "array(struct(1 as `p.q`)) as nested")
    names = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, small)
        if k < 4:
            assert docs.columns == names
        rows = docs.collect()
        assert rows and all(r["a.b"] == r["doc_id"] and r["extra"] == {"k": r["doc_id"]} and r["back`tick"] == 4 and r["my-col"] == 1 for r in rows)


def test_names():
    assert [n.split("_")[0] for n in queries()] == [f"op{k}" for k in range(1, 14)]
    assert set(oracle_sql()) <= set(queries())


def test_components(spark):
    links = [(k, k + 1) for k in range(100, 180)] + [(5, 3), (3, 9), (9, 5), (1, 1), (7, None)] + [(500, k) for k in range(501, 600)]
    got = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    real = [(a, b) for a, b in links if b is not None and a != b]
    assert {r.node: r.component for r in got} == components({x for p in real for x in p}, real)
    assert len(got) == len({x for p in real for x in p})
