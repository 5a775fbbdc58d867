"""Path patterns: globs and ignore lists compiled to one regular expression each, and path checks."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


class PathTraversalError(ValueError):
    """A path or pattern leaves the root."""


def glob_to_regex(glob: str) -> str:
    """``**`` is anything, ``*`` and ``?`` stay within one path segment, all else is literal."""
    special = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + re.sub(r"\*\*|\*|\?|[^*?]+", lambda m: special.get(m[0]) or re.escape(m[0]), glob) + "$"


def check_glob(glob: str) -> str:
    """The pattern with forward slashes; a ``..`` between slashes, braces or commas is refused."""
    plain = glob.replace("\\", "/")
    if ".." in re.split(r"[/{},]", plain):
        raise PathTraversalError(f"pattern leaves the root: {glob}")
    return plain


def literal_prefix(glob: str) -> str:
    """What every matching path starts with."""
    return re.split(r"[*?]", glob, maxsplit=1)[0]


def glob_filter(path: Column, globs: Iterable[str] | None) -> Column:
    """Whether a path matches any pattern. None or an empty list matches all, a list of blanks nothing.

    Each pattern's literal prefix stands before its regular expression as a startswith,
    which Parquet scans can use.
    """
    given = list(globs or [])
    if not given:
        return F.lit(True)
    out = F.lit(False)
    for glob in given:
        if glob.strip():
            clean = check_glob(glob)
            prefix = literal_prefix(clean)
            one = path.rlike(glob_to_regex(clean))
            out = out | ((path.startswith(prefix) & one) if prefix else one)
    return out


def ignore_regex(patterns: Iterable[str]) -> str | None:
    """One expression for a list of ignore patterns: each hides the path itself and all below, at any depth."""
    parts = []
    for p in patterns:
        p = p.replace("\\", "/").strip()
        p = p.removeprefix("./").rstrip("/")
        if p:
            body = glob_to_regex(p)[1:-1]
            parts.append(rf"(?:.*/)?{body}(?:/.*)?")
    return f"^(?:{'|'.join(parts)})$" if parts else None


def ignored(path: Column, patterns: Iterable[str]) -> Column:
    """Whether a path is hidden: some pattern hides it and no negated one (``!pattern``) names it."""
    given = [p.strip() for p in patterns]
    hide = ignore_regex(p for p in given if not p.startswith("!"))
    show = ignore_regex(p[1:] for p in given if p.startswith("!"))
    if hide is None:
        return F.lit(False)
    return path.rlike(hide) if show is None else path.rlike(hide) & ~path.rlike(show)


def line_glob_to_regex(glob: str) -> str:
    """The dialect of line-search programs: without a slash a pattern fits at any depth, ``{a,b}`` and ``[..]`` work, ``**/`` is any folders."""
    body, at, depth = "", 0, 0
    anchored = "/" in glob.rstrip("/")
    glob = glob.lstrip("/")
    while at < len(glob):
        c = glob[at]
        if glob.startswith("**/", at):
            body, at = body + "(?:.*/)?", at + 3
            continue
        if glob.startswith("**", at):
            body, at = body + ".*", at + 2
            continue
        if c == "[" and (end := glob.find("]", at + 2)) > 0:
            inner = glob[at + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            body, at = body + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
            continue
        if c == "{":
            body, depth = body + "(?:", depth + 1
        elif c == "}" and depth:
            body, depth = body + ")", depth - 1
        elif c == "," and depth:
            body += "|"
        else:
            body += {"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c)
        at += 1
    if depth:
        raise ValueError(f"unclosed brace: {glob}")
    tail = "" if not body.endswith("/") else ".*"
    return ("^" if anchored else "^(?:.*/)?") + body + tail + "$"


def line_glob_filter(path: Column, globs: Iterable[str] | None, hidden: bool = False) -> Column:
    """Whether a line search looks into a path: the last pattern that fits decides (``!`` excludes), and with a plain
    pattern given, paths that none fits are left out; files under a dot name only with ``hidden``."""
    given = [g.strip() for g in globs or [] if g.strip()]
    out = F.lit(not any(not g.startswith("!") for g in given))
    for g in given:
        fits = path.rlike(line_glob_to_regex(check_glob(g.removeprefix("!"))))
        out = F.when(fits, F.lit(not g.startswith("!"))).otherwise(out)
    return out if hidden else out & ~path.rlike(r"(^|/)\.[^/]")


#: Folders and files that are not indexed unless the caller says otherwise.
DEFAULT_IGNORES = (
    "node_modules", "AGENTS.md", ".git", ".worktrees", "dist", "build", "out", "coverage", ".cache", ".parcel-cache", "venv", ".venv",
    "env", ".idea", ".vscode", ".DS_Store", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "bun.lockb", "*.lock", "__pycache__",
    "*.pyc", ".pytest_cache", ".mypy_cache", ".ruff_cache",
)
#: Always ignored.
SECRETS = (".env", ".env.*")


def ignore_list(extra: Iterable[str] = ()) -> list[str]:
    """The union of the caller's patterns, or the defaults, with the secrets."""
    return list(dict.fromkeys([*(extra or DEFAULT_IGNORES), *SECRETS]))


def inside(path: Column) -> Column:
    """Relative, without a ``..`` segment."""
    return ~path.startswith("/") & ~path.rlike(r"(^|/)\.\.(/|$)")


def sanitize(root: str, path: str) -> str:
    """The path relative to root; it must lie inside by name and after links are followed. A missing file raises."""
    base = os.path.realpath(root)
    joined = os.path.normpath(os.path.join(base, path.replace("\\", "/")))
    if joined != base and not joined.startswith(base + os.sep):
        raise PathTraversalError(f"path leaves the root: {path}")
    real = os.path.realpath(joined, strict=True)
    if real != base and not real.startswith(base + os.sep):
        raise PathTraversalError(f"path leaves the root: {path}")
    return os.path.relpath(real, base).replace(os.sep, "/")


#: Fixed value: the classes of characters that a filter value may have.
_PRINTABLE = r"\A[\p{L}\p{N}\p{P}\p{Zs}\p{S}\p{M}]*\z"


def valid_filter_value(value: Column) -> Column:
    """Letters, numbers, punctuation, spaces, symbols and marks only: no control, private-use or invisible characters."""
    return value.rlike(_PRINTABLE)
