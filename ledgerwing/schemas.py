"""Schemas and reference values of the governance tables."""

from __future__ import annotations

# The vocabulary of the data model.
DIMENSIONS = (
    "database",
    "auth",
    "caching",
    "api-style",
    "deployment",
    "concurrency",
    "logging",
    "testing",
    "error-handling",
    "state-management",
    "messaging",
    "security",
)
DECISION_TYPES = ("constraint", "architectural", "technical", "product")
SOURCE_CONFIDENCE = {
    "manual": 0.95,
    "git_pr": 0.90,
    "git_release": 0.88,
    "meeting": 0.80,
    "git_issue": 0.70,
    "agent": 0.75,
    "git_commit": 0.60,
    "scan": 0.50,
}
VERDICTS = ("compatible", "tension", "contradiction")
SEVERITY_BY_TYPE = {"constraint": 1.0, "architectural": 0.9, "technical": 0.7, "product": 0.5}


# Table schemas, as DDL that every reader takes.
DECISION = (
    "id string, title string, content string, rationale string, status string, decision_type string, dimensions array<string>, "
    "constraints array<string>, alternatives array<string>, made_by string, project string, source_type string, confidence double, "
    "supersedes string, session_id string, created_at timestamp, valid boolean"
)
CONTRADICTION = (
    "id string, decision_a_id string, decision_b_id string, decision_a_title string, decision_b_title string, verdict string, "
    "reasoning string, evidence_a string, evidence_b string, shared_dimensions array<string>, confidence double, status string, "
    "resolved_by string, resolution_note string, detected_at timestamp, resolved_at timestamp, is_baseline boolean"
)
ASSUMPTION = (
    "id string, category string, status string, pattern_id string, summary string, "
    "code_evidence array<struct<file:string,line:int,snippet:string>>, confidence double, severity string, question string, "
    "options array<string>, selected_option int, resolved_by string, detected_at timestamp, resolved_at timestamp, "
    "deferred_until timestamp, is_baseline boolean"
)
SESSION = ("token string, project string, agent_id string, started_at timestamp, ended_at timestamp, decision_ids array<string>, context_loads int")
TRACE_EVENT = (
    "timestamp string, type string, action string, result string, file string, reason string, agent string, model string, "
    "input_tokens bigint, output_tokens bigint, cost_usd double, prompt_preview string"
)
SPAN = (
    "span_id string, trace_id string, agent_id string, model string, provider string, input_messages string, output string, tokens_in int, "
    "tokens_out int, cost_usd double, latency_ms double, status string, timestamp double, vclock map<string,int>, tainted_source string"
)
CAUSAL_EDGE = ("source_span_id string, target_span_id string, edge_type string, confidence double, detected_at timestamp")
TOOL_CALL = ("call_id string, tool_name string, arguments string, result_preview string, success boolean, duration_ms double, agent_id string, session_id string, timestamp double")
SHELL_RUN = ("execution_id string, command string, exit_code int, stdout string, stderr string, duration_ms double, agent_id string, session_id string, timestamp double")
VCS_OPERATION = ("operation_id string, operation string, branch string, commit_hash string, message string, agent_id string, session_id string, timestamp double")
FILE_READ = ("read_id string, path string, lines int, agent_id string, session_id string, timestamp double")
LABELLED_PAIR = ("pair_id string, decision_a string, decision_b string, label string, dimension string, reasoning string")
