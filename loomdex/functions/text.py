"""Lines, ranges, paths, languages, messages and durations as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lines(content: Column) -> Column:
    """Split at line feeds; a last empty piece stays."""
    return F.split(content, "\n", -1)


def lines_closed(content: Column) -> Column:
    """Like lines, but a final line feed opens no line and an empty text has none."""
    parts = lines(content)
    return F.when(content == "", F.array().cast("array<string>")).when(content.endswith("\n"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def utf16_length(s: Column) -> Column:
    return F.floor(F.octet_length(F.encode(s, "UTF-16LE")) / 2).cast("int")


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(x, high))


def dirname(path: Column) -> Column:
    """The parent folder, null at the top."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", ""))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def ancestors(path: Column) -> Column:
    """Every folder above a path, nearest the root first."""
    parts = F.split(path, "/", -1)
    return F.transform(F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


#: Languages by extension, for lines found by search.
LANGUAGE_OF = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "go": "go",
    "rs": "rust", "rb": "ruby", "php": "php", "java": "java", "c": "c", "cpp": "cpp", "h": "c", "hpp": "cpp",
    "cs": "csharp", "sh": "shell", "md": "markdown",
}
#: Extensions of the languages that have a parser, in order of registration.
PARSED = {"typescript": (".ts", ".tsx", ".js", ".jsx"), "python": (".py",), "go": (".go",)}


def extension_language(path: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in LANGUAGE_OF.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))), F.lit("unknown"))


def parser_language(path: Column) -> Column:
    """The first parser one of whose extensions ends the path, else text."""
    out = None
    for name, endings in PARSED.items():
        for ending in endings:
            hit = path.endswith(ending)
            out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit("text"))


#: The codes a failure can have.
ERROR_CODES = (
    "INTERNAL_ERROR", "STORAGE_UNAVAILABLE", "VECTOR_DIMENSION_MISMATCH", "CONTENT_NOT_FOUND", "INDEXING_IN_PROGRESS", "AUTH_REQUIRED",
    "ACCESS_DENIED", "WORKSPACE_NOT_FOUND", "REVISION_NOT_READY", "SYNC_OUT_OF_ORDER", "SYNC_RECONCILE_REQUIRED", "RATE_LIMITED",
)
#: Words in a message and the code they stand for, first match first.
ERROR_WORDS = (
    ("CONTENT_NOT_FOUND", r"^Invalid line range:"),
    ("INDEXING_IN_PROGRESS", r"^already_running$|Reindex already running"),
    ("VECTOR_DIMENSION_MISMATCH", r"(?i)dimension"),
    ("CONTENT_NOT_FOUND", r"(?i)enoent|no such file"),
    ("ACCESS_DENIED", r"(?i)permission denied|access denied|forbidden"),
    ("STORAGE_UNAVAILABLE", r"(?i)database|sqlite|storage|not initialized"),
)


def error_code(message: Column) -> Column:
    out = None
    for code, pattern in ERROR_WORDS:
        hit = message.rlike(pattern)
        out = F.when(hit, F.lit(code)) if out is None else out.when(hit, F.lit(code))
    return out.otherwise(F.lit("INTERNAL_ERROR"))


#: Messages of network failures, messages that show a local path, and what stands for the latter.
NETWORK_WORDS = r"(?i)fetch failed|econnrefused|econnreset|etimedout|https?://"
LOCAL_PATHS = r"(?i)/(home|users|tmp|var|etc|opt)/|[a-z]:\\|\.\./"
REDACTED = "Internal server error (potential path leak prevented)"


def redact(message: Column) -> Column:
    """Network failures keep their text; any other message that shows a local path is replaced as a whole."""
    return F.when(message.rlike(LOCAL_PATHS) & ~message.rlike(NETWORK_WORDS), F.lit(REDACTED)).otherwise(message)


def duration(ms: Column) -> Column:
    """``850ms`` below a second, then ``1.2s``."""
    return F.when(ms < 1000, F.concat(F.round(ms).cast("long").cast("string"), F.lit("ms"))).otherwise(F.concat(F.format_string("%.1f", (ms / 1000).cast("double")), F.lit("s")))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def escape_label(s: Column) -> Column:
    """Backslash, quote and line feed as a metrics exposition wants them."""
    return F.replace(F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
