"""The pipeline's stages, each against what it must keep."""

import corpus_pipeline
from tests.llm.test_operators import brute_fingerprint, classes
from tracewright.llm import toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "benchmark decontamination", "mixing", "sharding"]
    for name, stage in corpus_pipeline.STAGES:
        before, after = docs.collect(), stage(spark, docs, SF).collect()
        ids = [r.doc_id for r in after]
        assert len(ids) == len(set(ids)) and set(ids) <= {r.doc_id for r in before}
        if name == "toxicity":
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            kept = {r.doc_id for r in toxicity.scored(docs, labels).collect() if r.toxicity < 0.7}
            assert set(ids) == kept
        if name == "near duplicates":
            assert set(ids) == set(classes([r.doc_id for r in before], [brute_fingerprint(r["text"]) for r in before]))
        docs = spark.createDataFrame(after, docs.schema if name != "sharding" else None)
        assert docs.columns[: len(columns)] == columns and (name == "sharding") == ("shard" in docs.columns)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(ids)


def test_clashing_columns(spark):
    """Columns called like what the stages add pass through them."""
    names = ("toxicity", "_hash", "n_items", "coverage", "item_id", "row", "id", "fp", "domain", "copies", "key")
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", *(f"{i} AS `{c}`" for i, c in enumerate(names)))
    for _, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns and {tuple(r[c] for c in names) for r in after.collect()} == {tuple(range(len(names)))}
