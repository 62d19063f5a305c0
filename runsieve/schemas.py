"""Closed vocabularies and table schemas."""

OUTCOMES = ("pass", "fail", "error", "skip")
CAUSES = (
    "RACE_CONDITION",
    "TIMING_DEPENDENCY",
    "TEST_ORDER_DEPENDENCY",
    "EXTERNAL_DEPENDENCY",
    "SHARED_STATE_LEAK",
    "RESOURCE_EXHAUSTION",
    "INFRA_FLAKE",
    "REAL_REGRESSION",
    "UNKNOWN",
)
#: Causes that say something else than "this test is flaky".
NOT_FLAKE_CAUSES = ("REAL_REGRESSION", "INFRA_FLAKE", "UNKNOWN")
VERDICTS = ("regression", "flaky", "persistent_failure", "new_failure", "healthy")  # in the order of reports
OPEN_STATES = ("recommended", "active")

CASE = (
    "name string, classname string, suite_path string, file_path string, line int, duration_ms long, outcome string, "
    "failure_type string, failure_message string, stack_trace string, stdout string, stderr string, "
    "rerun_observed boolean, source_file string, position int"
)
WARNING = "origin string, reason string, detail string"
RUN = "run_id string, attempt int, shard_id string, commit_sha string, branch string, worker_id string, started_at timestamp_ntz"
IDENTITY = "fingerprint string, suite_path string, test_name string, parameters string, file_path string"
CHANGE = (
    "origin string, path string, old_path string, change_type string, binary boolean, "
    "new_ranges array<struct<start:long,end:long>>, old_ranges array<struct<start:long,end:long>>"
)
SCHEMA_VERSION = 1
