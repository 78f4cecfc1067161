"""Character kinds and lower case as the public tokenizers library has them.

The library's split patterns know the letters and numbers of Unicode 16, its lower case that of Unicode 17. Python's
tables may be older and the regex module's newer, so both are put right here by what the standard added.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
import regex

#: Unicode white space. str.split() would also break at U+001C to U+001F, which are none.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
OTHER, LETTER, NUMBER = range(3)
#: Code points that Unicode 16 made letters and numbers.
NEW_LETTERS = "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF 1E5D0-1E5ED 1E5F0"
NEW_NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"
#: Capital and small letters that Unicode 16 and 17 added; a range maps in step.
NEW_LOWER = "1C89>1C8A A7CB>264 A7CC>A7CD A7CE>A7CF A7D2>A7D3 A7D4>A7D5 A7DA>A7DB A7DC>19B 10D50-10D65>10D70 16EA0-16EB8>16EBB"


def _range(text: str) -> range:
    first, _, last = text.partition("-")
    return range(int(first, 16), int(last or first, 16) + 1)


@lru_cache(1)
def kinds() -> np.ndarray:
    """OTHER, LETTER or NUMBER of every code point."""
    kind = {"L": LETTER, "N": NUMBER}
    table = np.array([kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)], np.uint8)
    for added, number in ((NEW_LETTERS, LETTER), (NEW_NUMBERS, NUMBER)):
        for part in added.split():
            table[_range(part)] = number
    return table


@lru_cache(1)
def _lower() -> tuple[dict[int, int], regex.Pattern]:
    table = {}
    for pair in NEW_LOWER.split():
        first, _, to = pair.partition(">")
        table |= {c: int(to, 16) + i for i, c in enumerate(_range(first))}
    return table, regex.compile("[" + "".join(map(chr, table)) + "]")


def lower(text: str) -> str:
    """Each letter by itself: str.lower() would look at the neighbours of a final sigma."""
    folded = text.replace("Σ", "σ").lower()
    table, found = _lower()
    return folded if folded.isascii() or not found.search(folded) else folded.translate(table)


def _ranges(points: np.ndarray) -> str:
    """Code points as the inside of a character class; none of them is a sign with a meaning there."""
    cuts = np.flatnonzero(np.diff(points) > 1) + 1
    return "".join(f"{chr(p[0])}-{chr(p[-1])}" for p in np.split(points, cuts)) if len(points) else ""


@lru_cache(4)
def split_pattern(pattern: str) -> regex.Pattern:
    r"""The pattern with the library's \s, \p{L} and \p{N}, which stand in positive classes or in [^\s\p{L}\p{N}]."""
    table = kinds()
    every = "".join(map(chr, (c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)))
    inside = {}
    for name, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER)):
        known = np.array([ord(c) for c in regex.findall(name, every)])
        own = np.flatnonzero(table == kind)
        inside[name] = _ranges(np.setdiff1d(known, own)), _ranges(np.setdiff1d(own, known))
    newer, older = ("".join(inside[n][i] for n in inside) for i in (0, 1))
    out = pattern.replace(r"[^\s\p{L}\p{N}]", f"(?:[^{WHITE}\\p{{L}}\\p{{N}}{older}]|[{newer}])" if newer else f"[^{WHITE}\\p{{L}}\\p{{N}}{older}]")
    for name, (more, less) in inside.items():
        out = out.replace(f"[{name}]", f"[[{name}{less}]--[{more}]]" if more else f"[{name}{less}]")
    return regex.compile(out, regex.V1)
