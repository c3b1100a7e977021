"""Splitting source text into chunks for embedding, by lines, members or whole functions.

Sizes are UTF-8 bytes, lines count from 1. The rules are sequential, so they run per row in an Arrow-fed function.
"""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FUNCTIONS = {"Function", "Method", "Constructor"}
DECLARATIONS = {"Class", "Interface", "Struct", "Enum", "Trait", "Impl", "Record", "Union", "Module", "Namespace", "Type", "TypeAlias", "Typedef", "Delegate", "Template"}
CHUNKS = "array<struct<content:string,start_line:int,end_line:int,mode:string>>"


def by_characters(content: str, size: int = 1200, overlap: int = 120, first: int = 1) -> list[tuple[str, int, int, str]]:
    """Greedy runs of lines of at most ``size`` bytes; the next run steps back whole lines within ``overlap``.

    A line longer than ``size`` is a run of its own. Where the lines stepped back over sum to
    ``overlap`` exactly, one more line comes with them.
    """
    size = size if size > 0 else 1200
    overlap = overlap if 0 <= overlap < size else size // 10
    lines = content.split("\n")
    cost = [len(x.encode()) + 1 for x in lines]
    out, start, held, floor = [], 0, 0, 0
    for i, c in enumerate(cost):
        if held + c > size and i > start:
            out.append((start, i - 1))
            back, total = i, 0
            while back - 1 > floor and total + cost[back - 1] <= overlap:
                back -= 1
                total += cost[back]
            if total and total == overlap and back - 1 > floor:
                back -= 1
            floor = i - 1
            start = back
            held = sum(cost[start:i])
        held += c
    if start < len(lines) and content:
        out.append((start, len(lines) - 1))
    return [("".join(x + "\n" for x in lines[a : b + 1]), first + a, first + b, "character") for a, b in out]


def by_members(content: str, size: int = 1200, overlap: int = 120, first: int = 1) -> list[tuple[str, int, int, str]]:
    """Cuts before each later line indented like the first; oversize members are cut by lines."""
    lines = content.split("\n")
    indent = lambda x: len(x) - len(x.lstrip(" \t"))
    full = [i for i, x in enumerate(lines) if x.strip()]
    if not full:
        return []
    base = indent(lines[full[0]])
    cuts = [0, *[i for i in full[1:] if indent(lines[i]) == base], len(lines)]
    out = []
    for a, b in zip(cuts, cuts[1:]):
        part = "\n".join(lines[a:b])
        if not part.strip():
            continue
        if len(part.encode()) <= size:
            out.append((part, first + a, first + b - 1, "declaration"))
        else:
            out += [(c, s, e, "declaration") for c, s, e, _ in by_characters(part, size, overlap, first + a)]
    return out


def chunk(content: str | None, label: str | None, size: int = 1200, overlap: int = 120, first: int = 1) -> list[tuple[str, int, int, str]]:
    if not content:
        return []
    if label in FUNCTIONS:
        if len(content.encode()) <= size:
            return [(content, first, first + content.count("\n"), "function")]
        return [(c, a, b, "function") for c, a, b, _ in by_characters(content, size, overlap, first)]
    if label in DECLARATIONS:
        return by_members(content, size, overlap, first)
    return by_characters(content, size, overlap, first)


def chunks(content: Column, label: Column, size: int = 1200, overlap: int = 120) -> Column:
    """An array of (content, start_line, end_line, mode) for each row."""

    @F.pandas_udf(CHUNKS)
    def run(text: pd.Series, kind: pd.Series) -> pd.Series:
        keys = ("content", "start_line", "end_line", "mode")
        return pd.Series([[dict(zip(keys, c)) for c in chunk(t, k, size, overlap)] for t, k in zip(text, kind)])

    return run(content, label)
