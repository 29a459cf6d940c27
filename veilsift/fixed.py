"""Word lists, patterns, thresholds and names that results depend on."""

from __future__ import annotations

# Ordered labels, least first.
SEVERITIES = {"low": 1, "medium": 2, "high": 3, "critical": 4}
CONFIDENCES = {"candidate": 1, "probable": 2, "high_confidence": 3, "verified": 4}
SARIF_LEVEL = {"critical": "error", "high": "error", "medium": "warning", "low": "note"}
SARIF_RANK = {"verified": 100.0, "high_confidence": 90.0, "probable": 60.0, "candidate": 30.0}

# The entropy screen.
MIN_LENGTH, MAX_PROSE_WORDS, MIN_ENTROPY, MAX_ENTROPY, MIN_NORMALIZED = 20, 2, 3.5, 8.0, 0.8
MAX_TOKEN, MAX_MATCH, MAX_PATH, MAX_DATE, LINE_CAP = 4096, 32_768, 4096, 128, 65_536
HASH_LENGTHS = (32, 40, 64)
ENTROPY_RULE = "high-entropy-string"

# Bounds of a scan.
MAX_FILE_BYTES, SNIFF_BYTES, MAX_CONTROL_RATIO = 10_485_760, 8192, 0.30
MAX_FILES, MAX_BLOBS, MAX_REFS = 100_000, 200_000, 800_000

# Redaction.
REDACTION, REDACTION_FALLBACK, MIN_HIDDEN, MAX_REVEALED, FINGERPRINT_HEX = "*" * 12, "#" * 12, 12, 8, 12

# What a token that is a template or a placeholder looks like.
TOKEN_TEMPLATE_VALUES = ("${...}", "{{...}}", "${}", "{}", "{{}}", "%...%", "...", "<%...%>", "@{...}")
TOKEN_TEMPLATE_PAIRS = (("${", "}"), ("{{", "}}"), ("<%", "%>"), ("%(", ")"), ("%(", "s"), ("@{", "}"), ("$(", ")"))
TOKEN_PLACEHOLDER_PARTS = (
    "example", "placeholder", "changeme", "change_me", "change-me", "redacted", "notreal", "not_real", "replaceme", "replace_me",
    "yourkey", "your_key", "your-key", "yoursecret", "yourtoken", "dummytoken", "xxxx", "abcdef", "123456", "dummy", "sample",
    "fake", "mock", "insert", "todo", "fixme",
)
TOKEN_PLACEHOLDER_WORDS = (
    "your", "yours", "here", "none", "null", "nil", "undefined", "unset", "empty", "void", "test", "testing", "todo", "fixme",
    "invalid", "unsetvalue",
)

# The same for a rule's match.
MATCH_TEMPLATE_PAIRS = (("${", "}"), ("{{", "}}"), ("<%", "%>"), ("@{", "}"), ("$(", ")"), ("{%", "%}"), ("%(", ")"), ("%(", "s"), ("%", "%"))
MATCH_PLACEHOLDER_PARTS = (
    "change_me", "changeme", "change-me", "example", "insert-key-here", "placeholder", "redacted", "replace_me", "replaceme",
    "replace-me", "your_api_key", "your-api-key", "your_key", "your-key", "yourkey", "your-secret", "yoursecret", "your-token",
    "yourtoken", "xxxxxx",
)
MATCH_PLACEHOLDER_WORDS = ("changeme", "dummy", "example", "fake", "fixme", "mock", "notreal", "placeholder", "redacted", "sample", "test", "testing", "todo", "xxxxx")
MATCH_PLACEHOLDER_PHRASES = ("insert key here", "replace me", "your api key", "your api key here", "your key here", "your password here", "your secret here", "your token here")

# Credential terms of a line.
CREDENTIAL_TERMS = (
    "api-key", "api-secret", "access-key", "access-token", "auth-token", "client-secret", "credential", "credentials",
    "encryption-key", "passphrase", "password", "passwd", "private-key", "refresh-token", "secret", "secrets", "signing-key",
    "token", "webhook",
)

# Names that a scan skips.
IGNORED_DIRECTORIES = (".git", ".hg", ".svn", ".venv", "venv", "env", "node_modules", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox")
IGNORED_DIRECTORY_SUFFIXES = (".egg-info", ".dist-info")
IGNORED_FILENAMES = (".DS_Store", "Thumbs.db", "desktop.ini", ".Spotlight-V100")
IGNORED_EXTENSIONS = (
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".webp", ".tiff", ".tif", ".avif", ".heic", ".psd", ".ai", ".eps",
    ".woff", ".woff2", ".ttf", ".otf", ".eot",
    ".mp3", ".wav", ".flac", ".ogg", ".aac", ".m4a", ".mp4", ".mov", ".avi", ".mkv", ".webm", ".wmv",
    ".zip", ".gz", ".bz2", ".xz", ".zst", ".7z", ".rar", ".tar", ".tgz", ".jar", ".war", ".whl", ".iso", ".dmg",
    ".class", ".pyc", ".pyo", ".pyd", ".so", ".dylib", ".dll", ".exe", ".bin", ".o", ".obj", ".a", ".lib", ".wasm", ".beam",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".db", ".sqlite", ".sqlite3", ".mdb", ".dat",
    ".pdb", ".dsym", ".prof", ".core",
)

# Patterns of the lexer and of token shapes.
TILE = (
    r"#[^\n]*+"
    r'|"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"'
    r"|'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'"
    r"|`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`"
    r"|[A-Za-z0-9_]++(?:[ \t]*+=[ \t]*+[A-Za-z0-9_\-+/.:~@%]++)?+"
    r"|[\"'`]"
    r"|[^#\"'`A-Za-z0-9_]++"
)
# The same as TILE with neighbours that can't be tokens put together, and classes that Java tests by table.
_ASSIGNS = r"[ \t]*+=[ \t]*+[\w\-+/.:~@%]"
COARSE_TILE = (
    rf"(?:\w++(?!{_ASSIGNS})|[^#\"'`\w]++)++"
    rf"|\w++{_ASSIGNS}++"
    r'|"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"'
    r"|'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'"
    r"|`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`"
    r"|#[^\n]*+"
    r"|[\"'`]"
)
ASSIGNMENT = rf"^\w++{_ASSIGNS}"
NAME_BEFORE_VALUE = r"^[A-Za-z0-9_]+[ \t]*=[ \t]*"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"
KEBAB = r"[A-Za-z][A-Za-z0-9]*(?:-[A-Za-z][A-Za-z0-9]*)+"
CALL_SHAPE = r"\(\s*[A-Za-z_)]"
ROLE = r"^:[a-z]+:"
ASSIGNED_NAME = r"""(?:^|[\s,{\[(])["']?([A-Za-z_][A-Za-z0-9_.\-]*)["']?\]?\s*(?::=|=>|[:=])\s*["']?\s*$"""
