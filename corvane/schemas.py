"""Schemas of the relations, and the ranks of their enumerations."""

from __future__ import annotations

POINT = "struct<line:int,col:int>"
RANGE = f"struct<start:{POINT},end:{POINT}>"
LOCATION = f"struct<file:string,range:{RANGE}>"

FILES = "path string, language string, loc int, blob_sha string, bytes_read long"
FUNCTIONS = f"symbol_id string, name string, file string, range {RANGE}, cc int, loc int, callees array<string>, ord int"
IMPORTS = f"file string, language string, module string, range {RANGE}, ord int"
DEFINITIONS = f"file string, language string, name string, range {RANGE}, min_args int, max_args int"
CALL_SITES = f"file string, language string, callee string, argc int, range {RANGE}, ord int"
BINDINGS = f"file string, callee string, name string, range {RANGE}, ord int"
STATEMENTS = f"file string, name string, range {RANGE}, ord int, statements array<struct<range:{RANGE},label:string,writes:array<string>,reads:array<string>>>"
PACKAGES = "ecosystem string, name string, source_file string"
CHURN = "path string, churn_loc long"
DIAGNOSTICS = (
    f"id string, severity string, source string, code string, message string, file string, range {RANGE}, symbol string, "
    f"related array<struct<location:{LOCATION},message:string>>, fix struct<description:string,edits:array<struct<location:{LOCATION},new_text:string>>>, ord long"
)
NOTES_LOG = f"seq long, op string, id string, kind string, title string, body string, location {LOCATION}, symbol string, severity string, author string, ts timestamp"
CAPABILITIES = "capability string, available boolean, reason string"

#: Severities and how they collapse in an editor, sources in the order of their union, kinds of note.
SEVERITY_RANK = {"critical": 0, "error": 1, "warning": 2, "info": 3, "hint": 4}
CLIENT_SEVERITY = {"critical": "Error", "error": "Error", "warning": "Warning", "info": "Information", "hint": "Hint"}
SOURCE_ORDER = ("hallucination", "crossfile", "binding", "semgrep", "pyright", "tsc", "rust-analyzer", "pytea")
AI_SOURCES = ("hallucination", "cwe", "crossfile", "binding")
NOTE_PRIORITY = {"concern": 3, "question": 2, "intent": 1, "observation": 0}

#: Fixed value: extensions of the languages.
LANGUAGES = {"python": (".py", ".pyi"), "tsx": (".tsx",), "typescript": (".ts", ".mts", ".cts"), "rust": (".rs",)}
