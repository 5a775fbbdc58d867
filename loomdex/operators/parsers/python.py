"""Python: runs of imports, top-level classes, functions, and methods, by indentation."""

from __future__ import annotations

import re

from loomdex.operators.parsers.base import Declaration, Source, in_order

_BLANKS = re.compile(r"(?:[rRbBuUfF]{0,2})(?:\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)|#[^\n]*")
_HEAD = re.compile(r"^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+(\w+)")
_IMPORT = re.compile(r"^(?:import|from)\b")


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" \t"))


def _logical(lines: list[str], at: int) -> int:
    """The last line of the statement that starts at a line: brackets are closed and no backslash goes on."""
    depth = 0
    for i in range(at, len(lines)):
        depth += sum(lines[i].count(c) for c in "([{") - sum(lines[i].count(c) for c in ")]}")
        if depth <= 0 and not lines[i].rstrip().endswith("\\"):
            return i
    return len(lines) - 1


def parse(text: str) -> list[Declaration]:
    source = Source(text, _BLANKS)
    code, raw = source.code.split("\n"), text.split("\n")
    found: list[Declaration] = []

    def add(kind: str, name: str, first: int, last: int) -> None:
        while last > first and not raw[last].strip():
            last -= 1
        found.append(Declaration(kind, name, first + 1, last + 1, "\n".join(raw[first : last + 1]).strip("\n")))

    def body_end(at: int, indent: int) -> int:
        last = _logical(code, at)
        i = last + 1
        while i < len(code):
            if i + 1 in source.inside:
                last, i = i, i + 1
                continue
            if code[i].strip() and _indent(code[i]) <= indent:
                break
            if code[i].strip():
                i = _logical(code, i)
                last = i
            elif raw[i].strip() and _indent(raw[i]) > indent:
                last = i  # a comment or the inside of a string
            i += 1
        return last

    def walk(first: int, stop: int, indent: int, inside_class: bool) -> None:
        i, decorated = first, None
        while i < stop:
            line = code[i]
            if i + 1 in source.inside or not line.strip() or _indent(line) != indent:
                i += 1
                continue
            if line.lstrip().startswith("@"):
                decorated = i if decorated is None else decorated
                i = _logical(code, i) + 1
                continue
            head = _HEAD.match(line)
            if head:
                last = body_end(i, indent)
                start = i if decorated is None else decorated
                if head[2] == "class":
                    if not inside_class:
                        add("class", head[3], start, last)
                        below = next((k for k in range(_logical(code, i) + 1, last + 1) if code[k].strip()), None)
                        if below is not None:
                            walk(below, last + 1, _indent(code[below]), True)
                else:
                    add("method" if inside_class else "function", head[3], start, last)
                i, decorated = last + 1, None
                continue
            decorated = None
            if not inside_class and _IMPORT.match(line):
                start = last = i
                while i < stop and (not code[i].strip() and not raw[i].strip() or _IMPORT.match(code[i])):
                    if code[i].strip():
                        last = i = _logical(code, i)
                    i += 1
                add("import", "imports", start, last)
                continue
            i = _logical(code, i) + 1

    walk(0, len(code), 0, False)
    return in_order(found)
