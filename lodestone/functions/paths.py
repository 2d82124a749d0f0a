"""Path predicates and language detection as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of files that are never read.
BINARY_SUFFIXES = (
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".webp", ".tiff", ".svg",
    ".mp3", ".mp4", ".wav", ".ogg", ".flac", ".avi", ".mov", ".mkv", ".webm",
    ".zip", ".tar", ".gz", ".bz2", ".xz", ".7z", ".rar",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
    ".exe", ".dll", ".so", ".dylib", ".whl", ".egg",
    ".pyc", ".pyo", ".class",
    ".ttf", ".otf", ".woff", ".woff2", ".eot",
    ".db", ".sqlite", ".sqlite3",
    ".bin", ".dat", ".o", ".a",
)

# Folders that are never entered when indexing; the index folder is a parameter.
SKIP_DIRS = (".git", "__pycache__", "node_modules", ".venv", "venv", "env", "dist", "build", ".egg-info", ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".cache")
# Folders and suffixes whose changes are not followed.
WATCH_IGNORED_DIRS = (".git", "__pycache__", "node_modules", ".venv", "venv", "dist", "build", ".egg-info")
WATCH_IGNORED_SUFFIXES = (".pyc", ".pyo")
INDEX_DIR = ".lodestone"

# Language by suffix.
LANGUAGES = {
    ".py": "python", ".pyw": "python", ".pyi": "python",
    ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".ts": "typescript", ".mts": "typescript", ".cts": "typescript",
    ".jsx": "jsx", ".tsx": "tsx",
    ".java": "java",
    ".c": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp", ".hxx": "cpp", ".h": "c",
    ".cs": "csharp", ".go": "go", ".rs": "rust",
    ".rb": "ruby", ".rake": "ruby", ".gemspec": "ruby",
    ".php": "php", ".phtml": "php",
    ".swift": "swift", ".kt": "kotlin", ".kts": "kotlin", ".scala": "scala", ".sc": "scala",
    ".hs": "haskell", ".lhs": "haskell", ".lua": "lua", ".r": "r",
    ".sh": "bash", ".bash": "bash", ".zsh": "bash", ".fish": "bash",
    ".html": "html", ".htm": "html", ".xhtml": "html",
    ".css": "css", ".scss": "css", ".sass": "css", ".less": "css",
    ".json": "json", ".jsonc": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml",
    ".md": "markdown", ".mdx": "markdown", ".markdown": "markdown",
    ".sql": "sql", ".dockerfile": "dockerfile", ".regex": "regex",
    ".xml": "xml", ".svg": "xml",
    ".txt": "text", ".log": "text", ".env": "text",
    ".ini": "config", ".cfg": "config", ".conf": "config", ".properties": "config",
}
# Language by whole file name.
BARE_NAMES = {"dockerfile": "dockerfile", "Dockerfile": "dockerfile", "makefile": "bash", "Makefile": "bash"}


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """From the last dot of the name on, unless it begins or ends the name."""
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1)


def parent(path: Column) -> Column:
    """The folder of a relative path; "." at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit("."))


def relative_to(path: Column, root: str) -> Column:
    """Path below root; unchanged where it lies outside."""
    base = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(base)), F.substr(path, F.lit(len(base) + 1))).otherwise(path)


def _literals(mapping: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))


def language(path: Column) -> Column:
    """By the exact name, then by the lower-cased suffix, else unknown."""
    by_name = F.try_element_at(_literals(BARE_NAMES), file_name(path))
    by_suffix = F.try_element_at(_literals(LANGUAGES), F.lower(suffix(path)))
    return F.coalesce(by_name, by_suffix, F.lit("unknown"))


def _has_part(path: Column, names: tuple[str, ...]) -> Column:
    return F.exists(F.split(path, "/"), lambda p: p.isin(*names) | F.endswith(p, F.lit(".egg-info")))


def skipped(path: Column, index_dir: str = INDEX_DIR) -> Column:
    """True for what is not indexed. Every part counts, the file name too."""
    return F.lower(suffix(path)).isin(*BINARY_SUFFIXES) | _has_part(path, (*SKIP_DIRS, index_dir))


def watch_ignored(path: Column, index_dir: str = INDEX_DIR) -> Column:
    """True for changes that are not followed. The suffix is case-sensitive."""
    return suffix(path).isin(*WATCH_IGNORED_SUFFIXES) | _has_part(path, (*WATCH_IGNORED_DIRS, index_dir))
