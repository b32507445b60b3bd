"""Fixed word lists. These values define the results and are stated as they are."""

# Verdict words of messy input, the widest vocabulary.
PASS_WORDS = [
    "pass", "passed", "passing", "success", "successful", "ok", "okay", "good", "clean",
    "green", "true", "1", "yes", "y", "complete", "completed", "done",
]
FAIL_WORDS = [
    "fail", "failed", "failing", "failure", "error", "errored", "crash", "crashed", "bad",
    "red", "false", "0", "no", "n", "abort", "aborted", "timeout", "timedout", "fatal",
]

# Verdict words of outcome tables.
OUTCOME_PASS = ["pass", "passed", "ok", "success", "1", "true", "yes"]
OUTCOME_FAIL = ["fail", "failed", "error", "failure", "0", "false", "no"]

# Words that make an encoded target 1, and the subset the run table treats as failing.
TARGET_FAIL = ["fail", "failed", "0", "false", "no", "error", "bad"]
RUN_FAIL = ["fail", "failed", "error", "failure", "0", "false"]

# Words ignored when free text is searched for a verdict.
SCAN_SKIP_FAIL = ["no", "n", "0", "false"]
SCAN_SKIP_PASS = ["yes", "y", "1", "true", "done"]

NULLISH = [
    "", "na", "n/a", "nan", "none", "null", "nil", "-", "--", "?", "unknown",
    "unspecified", "<none>",
]
MISSING = "__missing__"
OTHER = "__other__"

VERDICT_KEYS = ["verdict", "pass_fail", "passfail", "result", "status", "outcome"]
OUTCOME_KEYWORDS = [
    "execution_time", "exec_time", "runtime", "duration", "throughput", "bandwidth",
    "latency", "iops", "error_type", "error_code", "error_msg", "exit_code", "result",
    "status", "score", "metric",
]
ID_NAMES = ["run_id", "id", "uuid", "guid", "test_id", "sample_id", "row_id", "index"]

# Header spellings of the run tables.
ID_ALIASES = ["run_id", "runid", "simulation_id", "sim_id", "test_id", "testid", "id"]
ID_SEARCH_ORDER = ["run_id", "runid", "simulation_id", "sim_id", "test_id", "testid"]
COLUMN_ALIASES = {
    "status": "pass_fail", "result": "pass_fail", "outcome": "pass_fail",
    "passfail": "pass_fail", "pass/fail": "pass_fail", "verdict": "pass_fail",
    "failure_class": "primary_error_tag", "failure_type": "primary_error_tag",
    "error_tag": "primary_error_tag", "error_type": "primary_error_tag",
    "err_tag": "primary_error_tag",
    "testcase": "test_name", "err_code": "error_code", "exec_time_ms": "execution_time_ms",
}

# Columns a run produces. None of them may be used to predict its verdict.
OUTCOME_COLUMNS = [
    "execution_time_ms", "throughput_mbps", "cycles", "uvm_error_count", "uvm_fatal_count",
    "uvm_error_total", "uvm_fatal_total", "uvm_warning_total", "verdict", "pass_fail",
    "primary_error_tag", "distinct_error_tags", "trace_fingerprint", "error_trace", "power_mw",
    "temperature_c", "area_mm2", "status", "error_msg", "notes", "timestamp", "log_file",
    "source_file",
]
NOT_FEATURES = ["run_id", "seed"]
DIFF_OUTCOMES = [
    "run_id", "seed", "execution_time_ms", "throughput_mbps", "cycles", "uvm_error_count",
    "uvm_fatal_count", "verdict", "pass_fail", "uvm_error_total", "uvm_fatal_total",
    "uvm_warning_total", "primary_error_tag", "distinct_error_tags", "trace_fingerprint",
    "error_trace",
]
# Names of derived measures that raw input tables must not carry.
DERIVED_COLUMNS = [
    "latency", "latency_ns", "response_latency", "failure_probability", "risk_score",
    "failure_rate", "correlation", "feature_importance", "shap_value", "cluster_id",
    "anomaly_score", "pareto_rank", "confidence", "root_cause", "predicted_status",
    "influence_score",
]
WAVEFORM_SUFFIXES = ["vcd", "fsdb", "wlf", "shm", "vpd", "trn"]
