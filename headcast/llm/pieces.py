"""Splitting texts by a tokenizer's pattern, and a bounded memo of what pieces encode to."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import regex


class Memo(dict):
    """``memo[piece]`` computes what it doesn't have. It holds at most ``size`` pieces used of late and as many used
    before; older ones are forgotten, so that frequent pieces stay. Long pieces aren't kept."""

    def __init__(self, compute: Callable, size: int, longest: int = 48):
        super().__init__()
        self.compute, self.size, self.longest = compute, size, longest
        self.older: dict = {}

    def __missing__(self, piece):
        value = self.older.get(piece)
        if value is None:
            value = self.compute(piece)
            if len(piece) > self.longest:
                return value
        if len(self) >= self.size:
            self.older = self.copy()
            self.clear()
        self[piece] = value
        return value


class Splitter:
    """All matches of a pattern that uses ``\\p{L}``, ``\\p{N}``, ``\\s`` and ``\\S`` as Unicode has them.

    For texts below U+0100 the same pattern is also compiled with those classes spelt out, which the standard
    engine runs about three times as fast; ``plain`` is built from the pattern, so both give the same matches.
    """

    def __init__(self, pattern: str):
        self.full = regex.compile(pattern)
        self.plain = re.compile(below_256(pattern))

    def __call__(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.full.findall(text)
        return self.plain.findall(text)


def below_256(pattern: str) -> str:
    """``pattern`` with its classes written out for code points under 256."""
    def members(test: Callable[[str], bool]) -> str:
        return "".join(re.escape(chr(c)) for c in range(256) if test(chr(c)))

    sets = {
        "\\p{L}": members(lambda c: unicodedata.category(c)[0] == "L"),
        "\\p{N}": members(lambda c: unicodedata.category(c)[0] == "N"),
        "\\s": members(lambda c: regex.fullmatch(r"\p{White_Space}", c) is not None),
    }
    out, at, inside = [], 0, False
    while at < len(pattern):
        name = next((n for n in sets if pattern.startswith(n, at)), None)
        if name:
            out.append(sets[name] if inside else f"[{sets[name]}]")
            at += len(name)
        elif pattern.startswith("\\S", at) and not inside:
            out.append(f"[^{sets['\\s']}]")
            at += 2
        elif pattern[at] == "\\":
            out.append(pattern[at : at + 2])
            at += 2
        else:
            inside = inside and pattern[at] != "]" or pattern[at] == "["
            out.append(pattern[at])
            at += 1
    return "".join(out)
