"""Record types of the analysed runs, as DDL strings. Every ingested table carries `seq`, its input order, as many operators depend on it."""

from __future__ import annotations

RUNS = ("project string not null, run_id string not null, root string, logs_dir string, artifacts_dir string")
BUILDS = ("source_dir string, build_dir string, compile_commands string, binaries array<string>, metadata map<string,string>, fuzzer_binary string")
FINDINGS = (
    "tool string, check_id string, file string, line int, severity string, title string, detail string, evidence_path string, function_name string, raw_payload string, seq bigint"
)
CRASHES = (
    "crash_id string, input_path string, input_size bigint, dedup_token string, harness string, timestamp timestamp, stack_trace string, signal string, seq bigint"
)
SEEDS = ("seed_id string, path string, size bigint, source string, seq bigint")
FUZZ_BATCHES = (f"project string, run_id string, harness string, duration_seconds double, seeds_initial bigint, seeds_found bigint, crashes array<struct<{CRASHES}>>")
FUNCTIONS = (
    "file_path string, seq bigint, name string, start_line int, end_line int, signature string, body string, byte_range struct<start_byte:int,end_byte:int>, is_small boolean"
)
SOURCE_FILES = ("path string, source string, parse_errors array<string>")
UNITS = ("file_path string, relative_file string, function_names array<string>, line_range string, code string, is_clubbed boolean, unit_idx int")
PATCH_ATTEMPTS = ("finding_id string, attempt_no int, timestamp timestamp, llm_response string, parse_error string")
PATCHES = ("analysis string, fix_strategy string, file_path string, patch string, raw_response string")
CRASH_TESTS = ("crash_id string, harness string, still_crashes boolean, error_message string, signal string")
PATCH_TESTS = (
    "project string, run_id string, patch_idx int, finding_id string, patch_applied boolean, build_success boolean, build_error string, "
    f"crashes_fixed int, crashes_remaining int, crash_tests array<struct<{CRASH_TESTS}>>"
)
TOOL_CALLS = ("timestamp timestamp, project string, run_id string, tool string, action string, detail string")
INFER_ISSUES = (
    "bug_type string, qualifier string, severity string, category string, line int, column int, procedure string, procedure_start_line int, file string, "
    "bug_trace array<struct<level:int,filename:string,line_number:int,column_number:int,description:string>>, key string, hash string, bug_type_hum string"
)
COMPILE_COMMANDS = ("directory string, command string, arguments array<string>, file string, output string")
