"""The folder for intermediate tables (see loomdex.scratch)."""

from __future__ import annotations

from loomdex.scratch import shared_dir

__all__ = ["shared_dir"]
