import os

from pyspark.sql import functions as F

from epochwright import session


def test_scratch_tables_can_be_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    table = session.materialize(spark.range(5), "five")
    assert table.count() == 5
    assert len(os.listdir(session._scratch_dir(spark))) == 1
    session.clear_scratch(spark)
    assert not os.path.exists(session._scratch_dir(spark))


def test_configured_folder_wins(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert session.shared_dir(spark) == configured
    assert session.scratch_path(spark, "x").startswith(session.shared_dir(spark))


def test_sized_writes_only_what_spark_would_not_broadcast(spark):
    side = spark.range(1000).groupBy((F.col("id") % 3).alias("k")).count()
    assert session.sized(side) is side
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2000")
    try:
        written = session.sized(side)
        assert written is not side and written.count() == 3
        big = spark.range(100_000).select((F.col("id") % 3).alias("k"))
        plan = big.join(written, "k")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
