"""TypeScript and JavaScript, without a compiler: a scan over the text with strings, comments and expressions blanked.

Found at the top level and in namespaces: imports (one declaration for all), interfaces,
type aliases, enums, namespaces, functions and classes with a body, default exports, and
exported variables; in classes: constructors, methods and accessors with a body.
Abstract members, overloads and ambient functions have no body and are left out, and so
are exported destructuring patterns.
"""

from __future__ import annotations

import re

from loomdex.operators.parsers.base import Declaration, Source, in_order

_BLANKS = re.compile(
    r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?"
    r"|`(?:\\[\s\S]|\$\{(?:[^{}`]|\{[^{}]*\}|`(?:\\[\s\S]|[^`\\])*`)*\}|[^`\\])*(?:`|\Z)"
    r"|(?<=[=(,:;!&|?{}\n])[ \t]*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*"
)
_IMPORT = re.compile(r"import\b(?!\s*[.(])")
_MODIFIERS = r"(?:(?:export|default|declare|abstract|async|public|private|protected|static|readonly|override)\s+)*"
_TOP = re.compile(rf"({_MODIFIERS})(function\b\s*\*?|class\b|interface\b|enum\b|const\s+enum\b|type\b|namespace\b|module\b|const\b|let\b|var\b)\s*([\w$]+|[\"'{{\[])?")
_DEFAULT = re.compile(r"export\s+default\s+")
_MEMBER = re.compile(rf"({_MODIFIERS})(?:(get|set)\s+(?=[\w$#\[\"']))?(?:\*\s*)?(constructor\b|#?[\w$]+|\[[^\]]*\])\s*[?!]?\s*(?=[(<])")


def _expression_end(source: Source, at: int) -> int:
    """The end of a statement: its semicolon, or a line's end at which no bracket is open and nothing goes on."""
    code, i = source.code, at
    while i < len(code):
        c = code[i]
        if c in "([{":
            i = source.close(i)
            continue
        if c == ";":
            return i + 1
        if c == "}":
            return i
        if c == "\n":
            before = code[at:i].rstrip()
            after = code[i:].lstrip()[:2]
            if before and not re.search(r"(=>|[=+\-*/%&|?:,.<(\[{!~^])$", before) and not re.match(r"[.?:&|=+*/%)\]}]|=>", after):
                return i
        i += 1
    return len(code)


def _body(source: Source, at: int) -> tuple[int, int] | None:
    """(start, end) of the block of a function, method or class head at ``at``; None if the head ends without one."""
    code, i = source.code, at
    while i < len(code):
        c = code[i]
        if c in "([":
            i = source.close(i)
        elif c == "{":
            # An object type stands after a colon or an operator of types.
            if re.search(r"[:|&<,]\s*$|\bextends\s*$", code[at:i]):
                i = source.close(i)
            else:
                return i, source.close(i)
        elif c in ";}":
            return None
        elif c == "\n" and not re.match(r"\s*[{:|&<(]|\s*(?:extends|implements)\b", code[i:]) and not re.search(r"[:|&<,(]\s*$|\b(?:extends|implements)\s*$", code[at:i]):
            return None
        else:
            i += 1
    return None


def parse(text: str) -> list[Declaration]:
    source = Source(text, _BLANKS)
    code = source.code
    found: list[Declaration] = []
    imports: list[tuple[int, int]] = []

    def lead(at: int, floor: int) -> int:
        """Where the comments and decorators right above a declaration begin."""
        part = text[floor:at]
        m = re.search(r"(?:(?:/\*\*(?:[^*]|\*(?!/))*\*/|//[^\n]*|@[\w.$]+(?:\([^)]*\))?)\s*)+\Z", part)
        return floor + m.start() if m else at

    def members(start: int, end: int) -> None:
        i = floor = start + 1
        while i < end - 1:
            c = code[i]
            m = _MEMBER.match(code, i) if re.match(r"[\w$#*\[]", c) and not re.match(r"[\w$]", code[i - 1]) else None
            if m:
                got = _body(source, m.end())
                if got and "abstract" not in m[1]:
                    raw = m[3]
                    kind = "constructor" if raw == "constructor" else "method"
                    name = f"{m[2]} {raw}" if m[2] else raw
                    found.append(source.declare(kind, name, lead(i, floor), got[1]))
                    i = floor = got[1]
                    continue
                i = _expression_end(source, m.end())
                floor = i = max(i, m.end())
                continue
            if re.match(r"[\w$#]", c) and not re.match(r"[\w$]", code[i - 1]):
                i = max(_expression_end(source, i), i + 1)
                floor = i
                continue
            i = source.close(i) if c in "([{" else i + 1

    def walk(i: int, end: int) -> None:
        floor = i
        while i < end:
            c = code[i]
            starts = re.match(r"[A-Za-z_$]", c) and (i == 0 or not re.match(r"[\w$.]", code[i - 1]))
            if not starts:
                i = source.close(i) if c in "([{" else i + 1
                continue
            if _IMPORT.match(code, i):
                stop = _expression_end(source, i)
                imports.append((lead(i, floor), stop))
                i = floor = stop
                continue
            m = _TOP.match(code, i)
            if not m:
                default = _DEFAULT.match(code, i)
                if default:
                    stop = _expression_end(source, default.end())
                    value = code[default.end() : stop]
                    kind = "function" if re.match(r"(async\s*)?(\([^)]*\)|[\w$]+)\s*(:[^=]+)?=>", value) else "variable"
                    found.append(source.declare(kind, "default", lead(i, floor), stop))
                else:
                    stop = _expression_end(source, i)
                i = floor = max(stop, i + 1)
                continue
            words, keyword, name = m[1].split(), m[2].split()[-1].rstrip("*"), m[3] or "default"
            if not re.match(r"[\w$]", name):
                name = text[m.start(3) : m.start(3) + 40].strip("\"'").split("'")[0].split('"')[0] if keyword in ("module", "namespace") else name
            begin = lead(i, floor)
            if "default" in words and (m[3] is None or m[3] in ("extends", "implements")):
                name = "default"
            if keyword in ("function", "class"):
                got = _body(source, m.end(3) if m[3] and name != "default" else m.end(2))
                stop = got[1] if got else _expression_end(source, m.end())
                if got:
                    found.append(source.declare(keyword, name, begin, stop))
                    if keyword == "class":
                        members(*got)
            elif keyword in ("interface", "enum", "namespace", "module"):
                brace = code.find("{", m.end(2))
                stop = source.close(brace) if brace >= 0 else _expression_end(source, m.end())
                kind = {"module": "namespace"}.get(keyword, keyword)
                found.append(source.declare(kind, name, begin, stop))
                if kind == "namespace" and brace >= 0:
                    walk(brace + 1, stop - 1)
            elif keyword == "type":
                stop = _expression_end(source, m.end())
                found.append(source.declare("typeAlias", name, begin, stop))
            else:
                stop = _expression_end(source, m.end())
                if "export" in words and re.match(r"[\w$]", name):
                    value = code[m.end() : stop]
                    value = value[value.find("=") + 1 :].strip() if re.search(r"(?<![=!<>])=(?![=>])", value) else ""
                    is_function = re.match(r"(async\s*)?(<[^>]*>\s*)?(\([\s\S]*?\)|[\w$]+)\s*(:[^={]+)?=>|(async\s+)?function\b", value) or re.match(r"[\w$.]+\s*(<[^(]*>)?\([\s\S]*(=>|\bfunction\b)", value)
                    found.append(source.declare("function" if is_function else "variable", name, begin, stop))
            i = floor = max(stop, m.end(2))

    walk(0, len(code))
    if imports:
        first, last = imports[0][0], imports[-1][1]
        found.append(Declaration("import", "imports", source.line(first), source.line(max(first, last - 1)), "\n".join(text[a:b].strip() for a, b in imports)))
    return in_order(found)
