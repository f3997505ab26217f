"""Schemas and fixed vocabularies of the review tables.

Every table is keyed by ``(repo, pr_number, filename)``; ``file_ord`` is the position of the file in its pull
request. Order inside a table is carried by columns, never by row order.
"""

from __future__ import annotations

PR_KEY = ["repo", "pr_number"]
FILE_KEY = ["repo", "pr_number", "file_ord", "filename"]

# Vocabularies.
SEVERITIES = ("critical", "error", "warning", "info")
CATEGORIES = ("style", "quality", "security", "best_practices")
VERIFICATION_STATUSES = ("passed", "failed", "warning", "skipped")
TEST_STATUSES = ("passed", "failed", "error", "skipped", "no_tests")
AGENT_ROLES = ("orchestrator", "reviewer", "refactorer", "verifier", "test_runner")

# Which files are reviewed.
SUPPORTED_EXTENSIONS = (
    ".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".go",
    ".rb", ".rs", ".c", ".cpp", ".h", ".hpp", ".cs",
)
SKIP_SUBSTRINGS = ("package-lock.json", "yarn.lock", "Pipfile.lock", ".min.js", ".min.css", ".map")

PULL_REQUESTS = (
    "repo STRING, pr_number BIGINT, title STRING, body STRING, base_branch STRING, head_branch STRING, "
    "author STRING, commits_count INT"
)
FILE_CHANGES = (
    "repo STRING, pr_number BIGINT, file_ord INT, filename STRING, status STRING, additions INT, "
    "deletions INT, patch STRING"
)
FILE_CONTENTS = "repo STRING, path STRING, ref STRING, sha STRING, content STRING"
VIOLATION_FIELDS = (
    "rule_id STRING, rule_name STRING, category STRING, severity STRING, file STRING, line INT, column INT, "
    "message STRING, suggestion STRING, code_snippet STRING, confidence DOUBLE"
)
VIOLATION_COLUMNS = [f.split()[0] for f in VIOLATION_FIELDS.split(", ")]
VIOLATIONS = (
    "repo STRING, pr_number BIGINT, file_ord INT, rule_ord INT, seq INT, " + VIOLATION_FIELDS
)
REVIEW_LOG = (
    "timestamp TIMESTAMP, event STRING, pr BIGINT, files_count INT, additions INT, deletions INT, "
    "rule_id STRING, file STRING, line INT, severity STRING, confidence DOUBLE, body STRING, "
    "suggestion_code STRING, reason STRING, target STRING, violations_fixed INT, sha STRING, passed STRING, "
    "total INT, success BOOLEAN, files ARRAY<STRING>, error STRING, message STRING, count BIGINT, "
    "total_violations BIGINT, comments_posted BIGINT"
)
