import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pipeline():
    return pytest.importorskip("corpus_pipeline")


def test_stages_on_odd_rows(pipeline, spark, odd, tmp_path):
    spark.createDataFrame([(3, 1, 0), (5, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet")
    )
    docs = odd
    for name, stage in pipeline.STAGES:
        made = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert made.columns == odd.columns
            made.write.parquet(str(tmp_path / name))
            docs = spark.read.parquet(str(tmp_path / name))
    kept = sorted(r["doc_id"] or 0 for r in docs.select("doc_id").collect())
    # texts 1 and 2 are equal once white space is one, as are 3 and 7; 4 (no word) is near 1, 6 near 5
    assert kept == [0, 1, 3, 5, 9]
    assert {r["doc_id"] or 0 for r in made.select("doc_id").distinct().collect()} == set(kept)


def test_stages_on_no_rows(pipeline, spark, nothing, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = nothing
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() == 0


def test_queries_are_registered(pipeline):
    from __spark_entry__ import queries

    names = set(queries())
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))


def test_sequences_follow_the_mix(pipeline, spark, documents, tmp_path):
    # the larger source has the smaller ids; targets are sizes to the power 0.5, so 2 : 1
    text = "seven words stand here, some of 100 " * 83
    docs = documents([(i, text + "x" * (i % 90), None, "a" if i < 1600 else "b") for i in range(2000)])
    stages = dict(pipeline.STAGES)
    stages["source_mixing"](spark, docs, "").write.parquet(str(tmp_path / "mixed"))
    mixed = spark.read.parquet(str(tmp_path / "mixed"))
    rows = stages["packing"](spark, mixed, "").collect()
    assert len({r["doc_id"] for r in rows}) == 2000
    last = max(r["sequence_id"] for r in rows)
    for share in (0.2, 0.4, 0.55):  # the smaller source runs out at 0.6
        part = [r for r in rows if r["sequence_id"] < share * last]
        tokens = sum(r["length"] for r in part)
        assert abs(sum(r["length"] for r in part if r["doc_id"] >= 1600) / tokens - 1 / 3) < 0.06
