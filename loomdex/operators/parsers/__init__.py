"""Parsers that find declarations in source text: one function for each language."""

from __future__ import annotations

from collections.abc import Callable

from loomdex.operators.parsers.base import Declaration
from loomdex.operators.parsers.go import parse as parse_go
from loomdex.operators.parsers.python import parse as parse_python
from loomdex.operators.parsers.typescript import parse as parse_typescript

PARSERS: dict[str, Callable[[str], list[Declaration]]] = {"typescript": parse_typescript, "python": parse_python, "go": parse_go}

__all__ = ["PARSERS", "Declaration", "parse_go", "parse_python", "parse_typescript"]
