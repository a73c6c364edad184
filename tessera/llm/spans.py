"""Spans of text as plain tuples, and their written form."""

from __future__ import annotations

import hashlib

#: (start, index of the kind, end): code points, end exclusive.
Span = tuple[int, int, int]


def written(spans: list[Span], kinds: tuple[str, ...]) -> str:
    """``kind:start:end`` by start, then by kind as listed, joined by commas."""
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def counts(spans: list[Span], kinds: int) -> list[int]:
    out = [0] * kinds
    for _, k, _ in spans:
        out[k] += 1
    return out
