"""Constant tables of the analysis."""

from __future__ import annotations

# Languages by file suffix.
LANGUAGE_BY_SUFFIX = {
    ".py": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".go": "go",
    ".java": "java",
    ".rs": "rust",
    ".cs": "csharp",
    ".kt": "kotlin",
    ".kts": "kotlin",
    ".php": "php",
    ".rb": "ruby",
}

# How a reference was resolved, with its score and label.
RESOLUTION = {
    "direct_symbol": (0.99, "very_high"),
    "same_class_method": (0.97, "very_high"),
    "same_module_symbol": (0.95, "high"),
    "import_exact": (0.93, "high"),
    "inheritance_exact": (0.90, "high"),
    "alias_resolved": (0.89, "high"),
    "barrel_reexport": (0.87, "high"),
    "super_dispatch": (0.86, "high"),
    "instance_dispatch": (0.84, "high"),
    "java_di_primary": (0.83, "medium_high"),
    "java_di_qualifier": (0.81, "medium_high"),
    "java_di_unique_impl": (0.78, "medium_high"),
    "string_ref": (0.75, "medium_high"),
    "heuristic": (0.65, "medium"),
    "ambiguous_candidates": (0.0, "ambiguous"),
    "doctype_link": (1.0, "very_high"),
    "doctype_child": (1.0, "very_high"),
    "doctype_controller": (0.9, "high"),
    "orm_load": (0.85, "high"),
}

# Weights of the line signals.
SIGNAL_WEIGHT = {
    "process_io": 2.9,
    "database_io": 2.8,
    "auth_guard": 2.8,
    "input_boundary": 2.7,
    "network_io": 2.6,
    "concurrency": 2.6,
    "orm_dynamic_load": 2.5,
    "state_mutation": 2.4,
    "filesystem_io": 2.4,
    "external_io": 2.2,
    "output_boundary": 2.1,
    "validation_guard": 2.0,
    "dynamic_dispatch": 2.0,
    "caching": 1.8,
    "error_handling": 1.7,
    "config_access": 1.6,
    "deserialization": 1.5,
    "serialization": 1.4,
    "time_or_randomness": 1.2,
}

# Families of signals.
SIDE_EFFECT = ("process_io", "database_io", "network_io", "concurrency", "state_mutation", "filesystem_io", "external_io")
BOUNDARY = ("input_boundary", "output_boundary")
GUARD = ("auth_guard", "validation_guard", "error_handling")
EXTERNAL_IO = ("process_io", "database_io", "network_io", "orm_dynamic_load", "filesystem_io", "caching")
CRITICAL = (
    "process_io",
    "database_io",
    "auth_guard",
    "input_boundary",
    "network_io",
    "concurrency",
    "orm_dynamic_load",
    "state_mutation",
    "filesystem_io",
    "external_io",
    "output_boundary",
    "validation_guard",
    "dynamic_dispatch",
    "caching",
)

# Weights of the risk score's terms, and its flags.
RISK_WEIGHT = {"instability": 0.24, "ca": 0.20, "betweenness": 0.14, "ce_internal": 0.12, "pagerank": 0.10, "git": 0.08, "cycle": 0.06, "self_call": 0.03, "entry": 0.02, "ce_external": 0.01}

# Limits of lists.
SIGNAL_REFS = 12
CYCLES_SHOWN = 20
DECLARED_NAMES = 20
MERGE_GAP = 2
PATH_EXTENSION_SCORE = 0.78

# Order of behavioural steps.
STEP_ORDER = {
    "input_boundary": 0,
    "deserialization": 1,
    "config_access": 2,
    "validation_guard": 3,
    "auth_guard": 4,
    "state_read": 5,
    "state_mutation": 6,
    "concurrency": 6,
    "orm_dynamic_load": 7,
    "caching": 7,
    "database_io": 7,
    "network_io": 8,
    "filesystem_io": 9,
    "process_io": 10,
    "serialization": 11,
    "output_boundary": 12,
    "error_handling": 13,
    "time_or_randomness": 14,
    "dynamic_dispatch": 15,
}

# Words of guard windows.
AUTH_WORDS = ("auth", "role", "permission", "scope", "token", "session", "principal", "credential")
GUARD_ACTIONS = ("raise ", "throw ", "return ", "return;", "return null", "return false", "return responseentity", "return res.", "res.status(", "abort(", "redirect(")
VALIDATION_WORDS = (" not ", "null", "undefined", "blank", "empty", "invalid", "missing", "required", "isblank(", "isempty(", "hastext(")

# Kinds of nodes.
EXECUTABLE_KINDS = ("function", "async_function", "method")
CONTAINER_KINDS = ("class", "interface", "enum", "record", "module")

# Orders of labels and states.
LABEL_ORDER = {"ambiguous": 0, "medium": 1, "medium_high": 2, "high": 3, "very_high": 4}
COMPLETENESS_ORDER = {"missing": 0, "context_only": 1, "partial": 2, "complete": 3}
OUTCOME_ORDER = {"unproven": 0, "ambiguous": 1, "partial": 2, "confirmed": 3}

# Words of questions.
STOPWORDS = ("a", "an", "and", "are", "before", "does", "for", "how", "i", "in", "is", "of", "or", "the", "this", "to", "what", "where", "which")
GENERIC_WORDS = ("read", "write", "path", "state", "check", "fetch", "load", "update", "change", "create", "open", "close", "request", "response")
INTENT_WORDS = {
    "explain_flow": ("how", "flow", "reach", "path", "through", "before", "after"),
    "debug": ("debug", "broken", "bug", "why"),
    "refactor": ("refactor", "simplify", "cleanup", "clean"),
    "architecture": ("architecture", "layer", "module", "dependency", "structure"),
    "auth": ("auth", "permission", "role", "token", "session", "authorize"),
    "validation": ("validate", "validation", "invalid", "guard", "check", "required"),
    "error_handling": ("error", "exception", "throw", "catch", "fail"),
    "data_access": ("db", "database", "repository", "query", "persistence", "jdbc"),
    "network": ("fetch", "http", "https", "api", "request", "network"),
    "filesystem": ("file", "disk", "fs", "path"),
    "side_effects": ("mutate", "mutation", "state", "assign", "update", "change", "write"),
    "ambiguity_resolution": ("ambiguous", "ambiguity", "unresolved", "candidate", "di", "dependency injection"),
}
SIGNAL_WORDS = {
    "auth_guard": ("auth", "permission", "role", "token", "session", "authorize"),
    "validation_guard": ("validate", "validation", "invalid", "guard", "check", "required"),
    "database_io": ("db", "database", "repository", "query", "persistence", "jdbc"),
    "network_io": ("fetch", "http", "https", "api", "request", "network"),
    "filesystem_io": ("file", "disk", "fs", "path"),
    "state_mutation": ("mutate", "mutation", "state", "assign", "update", "change", "write"),
    "input_boundary": ("input", "request", "handler", "controller"),
    "output_boundary": ("output", "response", "return json"),
    "error_handling": ("error", "exception", "throw", "catch", "fail"),
}

# Kinds of tainted input, first one first, and what shows them.
TAINT_WORDS = {
    "http_param": ("frappe.form_dict", "frappe.request.json", "frappe.local.form_dict"),
    "cli_arg": ("sys.argv", "argparse", "click.argument", "click.option"),
    "event_hook": ("doc.as_dict()", "frappe.get_doc"),
    "file_read": ("open(", "json.load", "yaml.safe_load", "toml.load"),
    "env_var": ("os.environ", "os.getenv"),
    "external_api": ("requests.get", "requests.post", "httpx.get", "httpx.post"),
}

# States in which a worker's result may end.
COMPLETION_STATES = ("ready_for_execution", "in_progress", "completed_within_bounds", "stopped_on_guardrail", "stopped_on_ambiguity", "stopped_on_insufficient_evidence", "invalid_result")
TERMINAL_STATES = ("completed_within_bounds", "stopped_on_guardrail", "stopped_on_ambiguity", "stopped_on_insufficient_evidence", "invalid_result")
