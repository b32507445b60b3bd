from types import SimpleNamespace

import pytest
from runlens import session


def test_a_cluster_needs_a_shared_folder():
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    spark = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, default: default))
    with pytest.raises(RuntimeError):
        session.shared_dir(spark)


def test_cut_keeps_rows_and_prunes_columns(spark):
    df = session.cut(spark.range(10).selectExpr("id", "id * 2 AS twice"))
    assert df.count() == 10 and "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<twice:bigint>" in df.select("twice")._jdf.queryExecution().executedPlan().toString()
