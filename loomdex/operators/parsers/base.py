"""What parsers share: the declaration record, and a copy of the text with strings and comments blanked."""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Declaration:
    kind: str
    name: str
    start: int
    end: int
    content: str


class Source:
    """Text with a blanked copy of equal length, and line numbers from 1."""

    def __init__(self, text: str, blanks: re.Pattern) -> None:
        self.text = text
        self.code = blanks.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
        self._breaks = [i for i, c in enumerate(text) if c == "\n"]
        #: Lines, from 1, that begin inside a string or comment.
        self.inside: set[int] = set()
        for m in blanks.finditer(text):
            if "\n" in m[0]:
                self.inside.update(range(self.line(m.start()) + 1, self.line(m.end() - 1) + 1))

    def line(self, at: int) -> int:
        return bisect.bisect_left(self._breaks, at) + 1

    def close(self, at: int) -> int:
        """The place after the bracket that closes the one at ``at``, or the text's end."""
        pairs, depth = {"(": ")", "[": "]", "{": "}"}, 0
        for i in range(at, len(self.code)):
            c = self.code[i]
            if c in pairs:
                depth += 1
            elif c in ")]}":
                depth -= 1
                if depth == 0:
                    return i + 1
        return len(self.code)

    def declare(self, kind: str, name: str, start: int, end: int) -> Declaration:
        """Trimmed of blank space at both ends; lines follow the trimmed text."""
        raw = self.text[start:end]
        start += len(raw) - len(raw.lstrip())
        end = start + len(raw.strip())
        return Declaration(kind, name, self.line(start), self.line(max(start, end - 1)), self.text[start:end])


def in_order(found: list[Declaration]) -> list[Declaration]:
    return sorted(found, key=lambda d: d.start)
