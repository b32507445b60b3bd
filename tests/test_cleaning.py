import pytest
from pyspark.sql import functions as F
from runlens.functions.text import norm_token
from runlens.operators import cleaning, merge, roles
from runlens.sources import tables


def frame(spark, n=200):
    return spark.range(n).select(
        F.concat(F.lit("R"), F.col("id").cast("string")).alias("run_id"),
        F.when(F.col("id") % 4 == 0, "FAILED").otherwise("passed").alias("verdict"),
        F.when(F.col("id") % 2 == 0, " Big-One ").otherwise("big_one").alias("size"),
        F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("kind"),
    )


def test_norm_token(spark):
    cases = {" SMALL ": "small", "Small--Case": "small_case", "small_": "small", "a \t-b__c": "a_b_c", "": "", "-": "", "Big": "big"}
    df = spark.createDataFrame([(k,) for k in cases], "v string").select("v", norm_token(F.col("v")).alias("t"))
    assert {r["v"]: r["t"] for r in df.collect()} == cases


def test_clean_merges_spellings_and_drops_constants(spark):
    out, report = cleaning.clean(frame(spark))
    assert report.target == "verdict" and report.rows_out == 200
    assert ("size", "constant", 1) in report.changes
    assert {r["kind"] for r in out.collect()} == {"x", "y"}


def test_failure_modes_are_loud(spark):
    with pytest.raises(ValueError):
        cleaning.clean(frame(spark).withColumn("verdict", F.lit("maybe")))
    with pytest.raises(ValueError):
        cleaning.clean(frame(spark).withColumn("verdict", F.lit("pass")), target="verdict")
    with pytest.raises(KeyError):
        cleaning.clean(frame(spark), target="nope")
    odd = frame(spark).withColumn("verdict", F.when(F.col("run_id") == "R1", "weird").otherwise(F.col("verdict")))
    _, report = cleaning.clean(odd)
    assert report.rejected == 1 and report.warnings


def test_verdict_compared_by_value(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 0.0), ("c", None)] * 30, "k string, ok double")
    assert cleaning.detect_target(df) == "ok"
    assert {r["ok"]: r["count"] for r in cleaning.normalize_target(df, "ok").groupBy("ok").count().collect()} == {"pass": 30, "fail": 30}


def test_roles_need_a_binary_target(spark):
    with pytest.raises(ValueError):
        roles.detect_roles(spark.range(30).selectExpr("id AS x"))


def test_merge_rejects_fan_out(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "run_id int, pass_fail string")
    b = spark.createDataFrame([(1, 5), (1, 6)], "run_id int, knob int")
    with pytest.raises(ValueError):
        merge.merge_tables({"outcomes": a, "config": b})
    out = merge.merge_tables({"config": b.limit(1), "outcomes": a})
    assert out.columns[0] == "run_id" and out.count() == 2


def test_csv_family_end_to_end(spark, tmp_path):
    (tmp_path / "config.csv").write_text("runId,testcase,fifo depth\nA,t1,4\nB,t2,8\n")
    (tmp_path / "outcomes_1.csv").write_text("runId,result,failure_class\nA,Passed,\n")
    (tmp_path / "outcomes_2.csv").write_text("runId,result,failure_class\nB,FAIL,TIMEOUT\n")
    (tmp_path / "transactions.csv").write_text("Run_ID,latency,kind\nA,1,x\nA,3,y\nB,5,x\n")
    (tmp_path / "registers.csv").write_text("run_id,reg\nA,r1\n")
    (tmp_path / "extra.csv").write_text("simulation_id,note\nA,hello\n")
    runs, _ = merge.combine(tables.load_tables(spark, str(tmp_path)), None, None)
    got = {r["run_id"]: r.asDict() for r in runs.collect()}
    assert got["A"]["pass_fail"] == "pass" and got["B"]["pass_fail"] == "fail"
    assert got["A"]["txn_latency_mean"] == 2.0 and got["A"]["n_transactions"] == 2
    assert got["A"]["n_register_accesses"] == 1 and got["B"]["n_register_accesses"] is None
    assert got["A"]["note"] == "hello" and got["B"]["test_name"] == "t2"
    assert got["B"]["primary_error_tag"] == "TIMEOUT" and got["B"]["trace_fingerprint"] == "TIMEOUT"


def test_each_csv_file_is_read_in_its_own_charset(spark, tmp_path):
    (tmp_path / "config 1,a.csv").write_bytes("\ufeffrunId,größe,note\nA,1,é€\n".encode())
    (tmp_path / "config_[2].csv").write_bytes("runId,größe,note\nB,2,éü\n".encode("latin-1"))
    (tmp_path / "config_3.CSV").write_bytes('runId,größe,note\nC,x,"“q” – ""z"",\nnext"\nD,4,\n'.encode("cp1252"))
    (tmp_path / "config_4.csv").write_bytes(b"")
    (tmp_path / "config_5.csv").write_bytes(b"runId,note\nE,\x81\x93\n")  # 81 is not in cp1252
    (tmp_path / "notes.txt").write_text("runId,note\nF,no\n")
    out = tables.load_tables(spark, str(tmp_path))
    assert list(out) == ["config"]
    got = {r["run_id"]: (r["größe"], r["note"]) for r in out["config"].collect()}
    assert got == {
        "A": ("1", "é€"), "B": ("2", "éü"), "C": ("x", '“q” – "z",\nnext'), "D": ("4", None), "E": (None, "\x81\x93"),
    }


def test_files_alike_share_one_reader(spark, tmp_path):
    for i in range(40):
        sub = tmp_path / f"d{i % 3}"
        sub.mkdir(exist_ok=True)
        (sub / f"config_{i}.csv").write_text(f"run_id,knob\nr{i},{i}\n" if i % 2 else f"run_id,depth\nr{i},{i}\n")
    groups = tables.csv_groups(tables.probe_csv(spark, str(tmp_path), tables.CSV_FILES)).collect()
    assert sorted(len(g["paths"]) for g in groups) == [20, 20]
    rows = tables.load_tables(spark, str(tmp_path))["config"].collect()
    assert {(r["run_id"], r["knob"], r["depth"]) for r in rows} == {(f"r{i}", i if i % 2 else None, None if i % 2 else i) for i in range(40)}


def test_header_rules(spark):
    raw = spark.createDataFrame([(1, 2, 3, 4)], "`Test_ID` int, `Run ID` int, `Status` int, `Result` int")
    assert tables.normalise_header(raw).columns == ["test_id", "run_id", "pass_fail"]
    assert tables.id_column(["foo", "grid_x", "id"]) == "grid_x" and tables.id_column(["foo"]) is None


def test_numbered_ids_are_consecutive_and_repeatable(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("a"))
    one = tables.hash_numbered(df).collect()
    assert sorted(r["run_id"] for r in one) == [f"RUN-{i:06d}" for i in range(1, 1001)]
    assert set(one) == set(tables.hash_numbered(df.repartition(13)).collect())
