"""Go: imports, types, functions and methods at the top level."""

from __future__ import annotations

import re

from loomdex.operators.parsers.base import Declaration, Source, in_order

_BLANKS = re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|`[^`]*(?:`|\Z)|'(?:\\.|[^'\\\n])+'")
_TOP = re.compile(r"^(import|type|func)\b", re.M)
_NAME = re.compile(r"\s*(\w+)")
_SPEC = re.compile(r"^[ \t]*(\w+)[^\n]*", re.M)


def _statement_end(source: Source, at: int) -> int:
    """The end of a declaration: its line's end once every bracket that it opens is closed."""
    i, code = at, source.code
    while i < len(code):
        if code[i] in "([{":
            i = source.close(i)
        elif code[i] == "\n":
            return i
        else:
            i += 1
    return len(code)


def _func_end(source: Source, at: int) -> int:
    """After the body; braces of interface or struct types in the signature are passed over."""
    i, code = at, source.code
    while i < len(code):
        c = code[i]
        if c in "([":
            i = source.close(i)
        elif c == "{":
            if re.search(r"\b(interface|struct)\s*$", code[at:i]):
                i = source.close(i)
            else:
                return source.close(i)
        elif c == "\n":
            return i
        else:
            i += 1
    return len(code)


def parse(text: str) -> list[Declaration]:
    source = Source(text, _BLANKS)
    found: list[Declaration] = []
    done = 0
    for m in _TOP.finditer(source.code):
        if m.start() < done:
            continue
        after = m.end()
        if m[1] == "func":
            rest = source.code[after:]
            lead = len(rest) - len(rest.lstrip(" \t"))
            receiver = rest.lstrip(" \t").startswith("(")
            at = source.close(after + lead) if receiver else after
            name = _NAME.match(source.code, at)
            done = _func_end(source, at)
            if name:
                found.append(source.declare("method" if receiver else "function", name[1], m.start(), done))
        elif m[1] == "import":
            done = _statement_end(source, after)
            if found and found[-1].kind == "import":
                last = found.pop()
                found.append(Declaration("import", "imports", last.start, source.line(done - 1), "\n".join(text.split("\n")[last.start - 1 : source.line(done - 1)])))
            else:
                found.append(source.declare("import", "imports", m.start(), done))
        else:
            done = _statement_end(source, after)
            group = re.match(r"[ \t]*\(", source.code[after:])
            if not group:
                name = _NAME.match(source.code, after)
                if name:
                    found.append(source.declare("class", name[1], m.start(), done))
                continue
            i = after + group.end()
            while i < done - 1:
                spec = _SPEC.match(source.code, i)
                if not spec:
                    i = source.code.find("\n", i) + 1 or done
                    continue
                end = _statement_end(source, spec.start())
                found.append(source.declare("class", spec[1], spec.start(), min(end, done)))
                i = end + 1
    return in_order(found)
