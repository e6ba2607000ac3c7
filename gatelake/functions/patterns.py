"""Patterns and word lists shared by the text audits."""

from __future__ import annotations

import re

# Fixed values -------------------------------------------------------------
COMMIT_TYPES = ("feat", "fix", "refactor", "docs", "test", "chore", "perf", "ci", "build", "style", "revert")
TITLE_PATTERN = r"^(feat|fix|refactor|docs|test|chore|perf|ci|build|style|revert)(\([A-Za-z0-9_./-]+\))?(!)?: .{1,}$"
SUBJECT_PATTERN = r"^(feat|fix|refactor|docs|test|chore|perf|ci|build|style|revert)(\(.+\))?(!)?: .{1,}$"
EXEMPT_SUBJECTS = ("Merge ", "Revert ", "fixup! ", "squash! ")
SUBJECT_MAX = 72
BODY_LINE_MAX = 100
CLOSING_WORDS = r"(?:close[sd]?|fix(?:es|ed)?|resolve[sd]?)"
BLANKS = r"[ \t\r\f]+"
TRUSTED_ASSOCIATIONS = ("OWNER", "MEMBER", "COLLABORATOR")
COMMANDS = (
    "assign", "unassign", "label", "unlabel", "priority", "close",
    "reopen", "duplicate", "needs-info", "triage", "help",
)
DOTENV_ALLOWED = (".env.example", ".env.sample", ".env.template")
LARGE_FILE_BYTES = 524_288
TEXT_EXTENSIONS = ("sh", "bats", "yml", "yaml", "json", "md", "toml", "py", "go", "ts", "tsx", "js", "jsx")
CODE_EXTENSIONS = ("ts", "tsx", "js", "py", "go", "java", "rs")
DOC_EXTENSIONS = ("md", "mdx")
FLAG_EXTENSIONS = ("ts", "tsx", "js", "jsx", "py", "go")
FLAG_PATTERN = r"flag\(['\"][^'\"]+['\"]"
SEVERITY_ORDER = ("low", "moderate", "high", "critical")
TITLE_STOP_WORDS = (
    "the", "and", "for", "are", "but", "not", "you", "all", "can", "how", "why", "with", "when",
    "from", "this", "that", "have", "been", "does", "need", "want", "just", "will", "into",
    "over", "also", "make",
)
TITLE_PREFIX_PATTERN = r"^(bug|feature|feat|question|docs|chore|refactor|perf|ci|build|style):?\s*"
DUPLICATE_KEYWORDS = 6
# ---------------------------------------------------------------------------

#: Secret rules of this library: rule id, literal that must occur, pattern.
SECRET_RULES = (
    ("assigned-token", "=", r"(?i)(?:token|secret|api_key|apikey|password)\s*=\s*\"[0-9a-f]{40}\""),
    ("aws-access-key", "AKIA", r"AKIA[0-9A-Z]{16}"),
    ("hosting-token", "gh", r"gh[pousr]_[A-Za-z0-9]{36}"),
    ("private-key", "PRIVATE KEY", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("json-web-token", "eyJ", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)


def glob_to_regex(glob: str) -> str:
    """Anchored regex for a path glob: ``**`` crosses folders, ``*`` and ``?`` do not."""
    steps = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    parts = re.split(r"(\*\*/|\*\*|\*|\?)", glob)
    return "^" + "".join(steps.get(p, re.escape(p)) for p in parts) + "$"


def extension_pattern(extensions: tuple[str, ...]) -> str:
    return r"\.(" + "|".join(extensions) + ")$"
