"""Tool names, aliases, parameters, phases and patterns that results depend on."""

TOOLS = ("list_files", "search_code", "read_file", "apply_patch", "run_test")

ALIASES = {
    "edit_file": "apply_patch",
    "update_file": "apply_patch",
    "modify_file": "apply_patch",
    "update_code": "apply_patch",
    "modify": "apply_patch",
    "write_file": "apply_patch",
    "ls": "list_files",
    "list_directory": "list_files",
    "find_files": "list_files",
    "grep": "search_code",
    "search": "search_code",
    "find_code": "search_code",
    "test": "run_test",
    "pytest": "run_test",
}

# tool, parameter, type, least, most, required
PARAMETERS = (
    ("list_files", "path", "string", None, None, False),
    ("list_files", "max_entries", "integer", 1, 1000, False),
    ("search_code", "query", "string", None, None, True),
    ("search_code", "path", "string", None, None, False),
    ("search_code", "max_results", "integer", 1, 200, False),
    ("read_file", "path", "string", None, None, True),
    ("read_file", "start_line", "integer", 1, None, False),
    ("read_file", "end_line", "integer", 1, None, False),
    ("apply_patch", "patch", "string", None, None, True),
    ("run_test", "command", "string", None, None, True),
)

PHASE_TOOLS = {
    "LOCATE": ("list_files", "search_code"),
    "UNDERSTAND": ("read_file", "search_code"),
    "MODIFY": ("apply_patch",),
    "VERIFY": ("run_test",),
}

EMPTY_PATCHES = ("", "(no changes)", "no changes", "null", "none")

ROLLOUT_TIMEOUT = r"(?i)\b(?:time[ -]?out|timed out|timeoutexpired|connecttimeout)\b"
ROLLOUT_ENVIRONMENT = r"(?i)(?:modulenotfounderror|importerror|filenotfounderror|connectionerror|connecterror|connection refused|network is unreachable|no space left|out of memory|cuda out of memory|prepared repository not found|infrastructure failed|policy_error)"
PLANNING_TIMEOUT = r"(?i)\b(time[ -]?out|timed out|timeoutexpired)\b"
PLANNING_ENVIRONMENT = r"(?i)(modulenotfounderror|importerror|filenotfounderror|connectionerror|no space left|out of memory|cuda out of memory|infrastructure failed|prepared repository not found|policy_error|model backend failed|broken installation|module 'collections' has no attribute 'mapping')"
TOOL_USAGE_ENVIRONMENT = r"(?i)(?:modulenotfounderror|importerror|filenotfounderror|connectionerror|connecttimeout|connection refused|network is unreachable|no space left|out of memory|cuda out of memory|setuptools_scm|prepared repository not found|infrastructure failed|error while parsing the following warning configuration)"
ACTION_ENVIRONMENT = r"(?i)(modulenotfounderror|no module named|importerror|cannot import name|missing dependency|hypothesis|setuptools_scm|pkg_resources|error loading conftest|error while loading|django.*import|module 'collections' has no attribute|python 3\.1[3-9]|command not found|no such file or directory.*python|broken installation|infrastructure failed|model backend failed)"
# Tools that count as calls in the rollout analysis; write_file is the older name of a patch.
CALLS = (*TOOLS, "write_file")
WRITES = ("write_file", "apply_patch")
