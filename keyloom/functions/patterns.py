"""Glob patterns as anchored regular expressions, and typed ranges as predicates."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

_SPECIAL = set("\\^$.|?*+()[]{}-&~#\"'<>=!:/ \t\n\r")


def _literal(char: str) -> str:
    return "\\" + char if char in _SPECIAL and not char.isspace() else char if char.isprintable() else f"\\x{{{ord(char):x}}}"


def _one_of(codes: set[int], negate: bool) -> str:
    if not codes:
        # An empty class matches nothing; its negation matches anything.
        return "." if negate else "(?!)"
    return ("[^" if negate else "[") + "".join(f"\\x{{{c:x}}}" for c in sorted(codes)) + "]"


def glob_regex(pattern: str) -> str:
    """``*``, ``?``, ``[a-z]``, ``[^x]`` and ``\\`` as an anchored Java regex.

    Reversed ranges are swapped; a class that never ends takes in the rest of
    the pattern; a backslash at the end stands for itself.
    """
    out, at, n = ["(?s)^"], 0, len(pattern)
    while at < n:
        char = pattern[at]
        if char == "*":
            while at + 1 < n and pattern[at + 1] == "*":
                at += 1
            out.append(".*")
        elif char == "?":
            out.append(".")
        elif char == "[":
            at += 1
            negate = at < n and pattern[at] == "^"
            at += negate
            codes: set[int] = set()
            while at < n and pattern[at] != "]":
                if pattern[at] == "\\" and at + 1 < n:
                    at += 1
                    codes.add(ord(pattern[at]))
                elif at + 2 < n and pattern[at + 1] == "-" and pattern[at + 2] != "]":
                    lo, hi = sorted((ord(pattern[at]), ord(pattern[at + 2])))
                    codes.update(range(lo, hi + 1))
                    at += 2
                else:
                    codes.add(ord(pattern[at]))
                at += 1
            out.append(_one_of(codes, negate))
        else:
            if char == "\\" and at + 1 < n:
                at += 1
                char = pattern[at]
            out.append(_literal(char))
        at += 1
    return "".join(out) + "\\z"


def glob(column: Column, pattern: str | bytes, binary: bool = False) -> Column:
    """Whether a column matches a glob; ``binary`` matches byte by byte."""
    if isinstance(pattern, bytes):
        pattern = pattern.decode("latin-1")
    if binary:
        column = F.decode(column.cast("binary"), "iso-8859-1")
    return column.rlike(glob_regex(pattern))


def parse_score(text: str | float) -> float:
    """A score; infinities are spelled inf, +inf, infinity; NaN is refused."""
    value = float(text) if not isinstance(text, str) else float({"+inf": "inf", "+infinity": "inf"}.get(text.lower(), text))
    if math.isnan(value) or isinstance(text, str) and (text != text.strip() or "_" in text):
        raise ValueError("min or max is not a float")
    return value


@dataclass(frozen=True)
class ScoreRange:
    """A closed, half-open or open interval of scores."""

    lo: float = -math.inf
    hi: float = math.inf
    lo_open: bool = False
    hi_open: bool = False

    @classmethod
    def parse(cls, lo: str | float, hi: str | float) -> "ScoreRange":
        """Bounds as commands write them: ``(5`` is exclusive, ``-inf`` unbounded."""
        ends = [(parse_score(x[1:]), True) if isinstance(x, str) and x[:1] == "(" else (parse_score(x), False) for x in (lo, hi)]
        return cls(ends[0][0], ends[1][0], ends[0][1], ends[1][1])

    def of(self, score: Column) -> Column:
        # Unbounded ends are left out, so that the scan gets a plain predicate.
        test = F.lit(True)
        if self.lo_open or self.lo != -math.inf:
            test = test & (score > self.lo if self.lo_open else score >= self.lo)
        if self.hi_open or self.hi != math.inf:
            test = test & (score < self.hi if self.hi_open else score <= self.hi)
        return test


@dataclass(frozen=True)
class LexRange:
    """An interval of members in byte order; None is unbounded."""

    lo: str | bytes | None = None
    hi: str | bytes | None = None
    lo_open: bool = False
    hi_open: bool = False

    @classmethod
    def parse(cls, lo: str | bytes, hi: str | bytes) -> "LexRange":
        """``-`` and ``+`` are unbounded, ``[x`` inclusive, ``(x`` exclusive."""

        def end(x):
            if x in ("-", "+", b"-", b"+"):
                return None, False
            if x[:1] in ("[", "(", b"[", b"("):
                return x[1:], x[:1] in ("(", b"(")
            raise ValueError("min or max not valid string range item")

        (a, a_open), (b, b_open) = end(lo), end(hi)
        return cls(a, b, a_open, b_open)

    def of(self, member: Column) -> Column:
        test = F.lit(True)
        if self.lo is not None:
            test = test & (member > F.lit(self.lo) if self.lo_open else member >= F.lit(self.lo))
        if self.hi is not None:
            test = test & (member < F.lit(self.hi) if self.hi_open else member <= F.lit(self.hi))
        return test
