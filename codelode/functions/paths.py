"""Column expressions for repository paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Excluded folders, secret names, binary suffixes, languages.
EXCLUDED_FOLDERS = [
    ".git", ".next", ".turbo", ".cache", ".venv", "__pycache__", "build", "coverage", "dist", "node_modules",
    "venv",
]
SECRET_NAME = r"(?s)^(\.env|\.env\..*|.*\.pem|.*\.key|id_rsa.*|.*\.p12|credentials\.json|secrets\..*)$"
BINARY_SUFFIXES = [
    ".7z", ".a", ".avi", ".bin", ".bmp", ".class", ".dll", ".dylib", ".exe", ".gif", ".gz", ".ico", ".jar", ".jpeg",
    ".jpg", ".mov", ".mp3", ".mp4", ".o", ".pdf", ".png", ".pyc", ".so", ".tar", ".tgz", ".wav", ".webp", ".zip",
]
LANGUAGES = {
    ".js": "javascript", ".jsx": "jsx", ".py": "python", ".ts": "typescript", ".tsx": "tsx",
    ".json": "config", ".yaml": "config", ".yml": "config", ".toml": "config",
    ".md": "documentation", ".txt": "documentation",
}


def normalize(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))


def basename(path: Column) -> Column:
    return F.coalesce(F.try_element_at(parts(path), F.lit(-1)), F.lit(""))


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1))


def is_excluded(path: Column) -> Column:
    return F.exists(
        parts(normalize(path)),
        lambda p: (p == "..") | p.isin(EXCLUDED_FOLDERS) | p.endswith(".egg-info"),
    )


def is_secret(path: Column) -> Column:
    return F.lower(basename(normalize(path))).rlike(SECRET_NAME)


def language(path: Column) -> Column:
    pairs = [F.lit(value) for item in LANGUAGES.items() for value in item]
    return F.try_element_at(F.create_map(*pairs), suffix(path))


def keeps_text(path: Column) -> Column:
    return suffix(path).isin(list(LANGUAGES))


def is_unsafe(path: Column) -> Column:
    """Empty, absolute, drive-letter or parent-escaping paths."""
    forward = F.replace(path, F.lit("\\"), F.lit("/"))
    return (
        (forward == "") | forward.startswith("/") | forward.rlike("^[A-Za-z]:")
        | F.array_contains(parts(forward), "..")
    )


def glob_regex(pattern: Column) -> Column:
    """Shell glob as an unanchored regular expression; * also crosses slashes."""
    escaped = F.regexp_replace(pattern, r"([.^$+{}()|\\])", r"\\$1")
    starred = F.regexp_replace(F.regexp_replace(escaped, r"\*", ".*"), r"\?", ".")
    return F.regexp_replace(starred, r"\[!", "[^")
