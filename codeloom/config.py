"""Tunables with their defaults; every operator takes them as parameters too."""

from __future__ import annotations

import os
from dataclasses import dataclass


def _env(name: str, default):
    """A default that the environment may override (FN20)."""
    v = os.environ.get(f"CODELOOM_{name.upper()}")
    return type(default)(v) if v is not None else default


@dataclass(frozen=True)
class Config:
    max_file_bytes: int = _env("max_file_bytes", 400_000)
    large_file_lines: int = _env("large_file_lines", 600)
    chunk_lines: int = _env("chunk_lines", 40)
    chunk_windows: int = _env("chunk_windows", 12)
    chunk_chars: int = _env("chunk_chars", 3000)
    snippet_chars: int = 200
    candidates: int = _env("candidates", 30)
    results: int = _env("results", 5)
    rrf_k: int = 60
    semantic_weight: float = 0.60
    lexical_weight: float = 0.40
    expansion_results: int = 5
    impact_depth: int = _env("impact_depth", 4)
    high_coupling: int = 8
    churn_days: int = _env("churn_days", 90)
    churn_top: int = _env("churn_top", 20)
    history_commits: int = 50
    sample_files: int = 20


DEFAULT = Config()
