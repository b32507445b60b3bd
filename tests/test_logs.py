from runlens.functions.text import mask
from runlens.sources import logs
from pyspark.sql import functions as F

BAR = "=" * 64


def block(run, config, issues=(), metrics='{"execution_time_ms":412.7,"cycles":9}', verdict="FAILED", extra=()):
    lines = [BAR, f"UVM SIMULATION LOG :: {run}", BAR, "[CONFIG]", config, "[/CONFIG]", "UVM_INFO @ 0 ns: reporter [RNTST] go",
             *issues, "[METRICS]", metrics, "[/METRICS]", "--- UVM Report Summary ---", "UVM_ERROR   :    1", "UVM_FATAL : 2", *extra]
    return "\n".join(lines + ([f"** TEST {verdict} **"] if verdict else []))


E1 = "UVM_ERROR @ 45210 ns: a.b.c [FIFO_OVERFLOW] text 0x1f 32"
E2 = "UVM_FATAL @ 45230 ns: a.b [TEST_ABORT] end"
CORPUS = "\n".join([
    block("RUN-1", '{"run_id":"x","q":32,"v":1.5,"n":"a"}', [E1, E1.replace("32", "33"), E2]),
    block("RUN-2", '{"q":\n2,\n"v":2,"n":"b","cycles":1}', verdict="PASSED"),
    block("RUN-3", '{"q":', [E1]),
    block("RUN-4", '{"q":5}', ["junk line", "UVM_WARNING @ 3 ns: a [W] fine"], verdict=None),
    block("RUN-5", "{}"),
    block("RUN-6", '{"q":1,"z":[1,2]}', [E2], metrics="{bad"),
]) + "\n"


def by_id(df):
    return {r["run_id"]: r.asDict() for r in df.collect()}


def write(tmp_path, name, text):
    (tmp_path / name).write_bytes(text.encode())


def test_file_scan(spark, tmp_path):
    write(tmp_path, "a.log", CORPUS)
    windows = "some text before\n" + block("RUN-7", '{"q":3}', [E2]).replace("\n", "\r\n") + "\r\n"
    write(tmp_path, "b.log", windows)
    runs, errors, stats = logs.read_logs(spark, str(tmp_path))
    rows = by_id(runs)
    assert set(rows) == {"RUN-1", "RUN-2", "RUN-4", "RUN-6", "RUN-7"}
    one = rows["RUN-1"]
    assert (one["q"], one["v"], one["n"], one["cycles"]) == (32, 1.5, "a", 9)
    assert one["primary_error_tag"] == "FIFO_OVERFLOW" and one["distinct_error_tags"] == 2
    assert one["trace_fingerprint"] == "text <ADDR> <N> || end"
    assert one["error_trace"] == "text 0x1f 32 text 0x1f 33 end"
    assert (one["uvm_error_total"], one["uvm_fatal_total"], one["uvm_warning_total"]) == (1, 2, 0)
    assert rows["RUN-2"]["cycles"] == 9, "metrics win over configuration"
    assert rows["RUN-2"]["trace_fingerprint"] == "CLEAN" and rows["RUN-2"]["pass_fail"] == "pass"
    assert rows["RUN-4"]["verdict"] == "UNKNOWN" and rows["RUN-4"]["pass_fail"] == "pass"
    assert rows["RUN-6"]["execution_time_ms"] is None
    assert rows["RUN-7"]["error_trace"] == "end"
    assert errors.count() == 5 and set(errors.columns) == set(logs.ERROR_COLUMNS)
    s = stats.first()
    assert (s["runs"], s["error_lines"], s["malformed_blocks"]) == (5, 5, 3)
    counts = logs.line_count(spark, str(tmp_path)).first()
    assert counts["files"] == 2 and counts["lines"] == len(CORPUS.splitlines()) + len(windows.splitlines())


def test_text_in_memory_equals_files(spark, tmp_path):
    write(tmp_path, "a.log", CORPUS)
    texts = spark.createDataFrame([(CORPUS,)], "value string")
    held = logs.runs_of(logs.parse_blocks(logs.split_blocks(texts)))
    assert by_id(held) == by_id(logs.read_logs(spark, str(tmp_path))[0])
    assert logs.parse_stats(logs.parse_blocks(logs.split_blocks(texts))).first()["unparsed_lines"] == 1


def test_splits_do_not_lose_blocks(spark, tmp_path):
    write(tmp_path, "a.log", "\n".join(block(f"RUN-{i}", '{"q":%d}' % i) for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        blocks = logs.read_blocks(spark, str(tmp_path))
        assert blocks.rdd.getNumPartitions() > 10
        rows = logs.runs_of(logs.parse_blocks(blocks), {"q": "bigint"}).select("run_id", "q").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(r["q"] for r in rows) == list(range(3000))


def test_mask(spark):
    cases = {
        "wr_ptr=0x1f depth=32": "wr_ptr=<ADDR> depth=<N>", "v1.2.3 keeps 4.5 x7 7x  end ": "v1.2.3 keeps <N> x7 7x end",
        "12": "<N>", "a 0xZZ 1": "a 0xZZ <N>", "t=3,4": "t=<N>,<N>",
    }
    df = spark.createDataFrame([(k,) for k in cases], "m string").select("m", mask(F.col("m")).alias("t"))
    assert {r["m"]: r["t"] for r in df.collect()} == cases


def test_logs_are_found_at_any_depth_and_case(spark, tmp_path):
    from runlens.plans.analysis import read_corpus

    (tmp_path / "sub").mkdir()
    for at, name in enumerate(["a.log", "sub/b.log", "X.LOG"]):
        write(tmp_path, name, block(f"RUN-{at}", '{"q":%d}' % at, [E2]) + "\n")
    runs, errors = read_corpus(spark, str(tmp_path))
    assert sorted(r["run_id"] for r in runs.collect()) == ["RUN-0", "RUN-1", "RUN-2"] and errors.count() == 3


def test_the_last_section_of_a_name_counts(spark, tmp_path):
    text = block("RUN-1", '{"q":1}', [E1]).replace("[/CONFIG]", '[/CONFIG]\n[CONFIG]\n{"q":2}\n[/CONFIG]')
    write(tmp_path, "a.log", text + "\n")
    assert [r["q"] for r in logs.read_logs(spark, str(tmp_path))[0].collect()] == [2]
