"""Differences of two texts: a shortest edit script of lines, and a ratio by longest matching pieces, in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RESULT = "added array<string>, removed array<string>, kept array<string>, script array<struct<op: string, line: string>>, ratio double"


def _rows(a: list, b: list) -> int:
    """After all of `a`, a bit for each item of `b`: the cleared ones among the first j count the longest common subsequence with b[:j]."""
    at: dict = {}
    for i, item in enumerate(b):
        at[item] = at.get(item, 0) | 1 << i
    row = whole = (1 << len(b)) - 1
    for item in a:
        met = row & at.get(item, 0)
        row = (row + met | row - met) & whole
    return row


def _prefixes(row: int, n: int) -> list[int]:
    out, total = [0], 0
    for digit in reversed(bin(row | 1 << n)[3:]):
        total += digit == "0"
        out.append(total)
    return out


def common(a: list, b: list) -> list[tuple[int, int]]:
    """Places (i, j) of a longest common subsequence.

    Halves of `a` are split where both sides together match most (Hirschberg),
    so memory grows with the longer list and not with the product.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, k, j, m = todo.pop()
        while i < k and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < k and j < m and a[k - 1] == b[m - 1]:
            k, m = k - 1, m - 1
            out.append((k, m))
        if i == k or j == m:
            continue
        if k - i == 1:
            if a[i] in b[j:m]:
                out.append((i, b.index(a[i], j, m)))
            continue
        half = (i + k) // 2
        part = b[j:m]
        left = _prefixes(_rows(a[i:half], part), len(part))
        right = _prefixes(_rows(a[half:k][::-1], part[::-1]), len(part))
        cut = max(range(len(part) + 1), key=lambda c: left[c] + right[len(part) - c])
        todo += [(i, half, j, j + cut), (half, k, j + cut, m)]
    return sorted(out)


def script(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """(op, line) in order: ' ' for lines of both, '-' for those of a alone, '+' for those of b alone, as few of the latter as can be."""
    out, i, j = [], 0, 0
    for x, y in [*common(a, b), (len(a), len(b))]:
        out += [("-", line) for line in a[i:x]] + [("+", line) for line in b[j:y]]
        if x < len(a):
            out.append((" ", a[x]))
        i, j = x + 1, y + 1
    return out


def _longest(a: str, b: str) -> tuple[int, int, int]:
    """(start in a, start in b, length) of the longest common piece, the first in a, then in b: a walk of a over b's suffix automaton."""
    size, link, ends, step = [0], [-1], [-1], [{}]
    last = 0
    for i, c in enumerate(b):
        new = len(size)
        size.append(size[last] + 1)
        link.append(0)
        ends.append(i)
        step.append({})
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if size[q] > size[p] + 1:
                twin = len(size)
                size.append(size[p] + 1)
                link.append(link[q])
                ends.append(ends[q])
                step.append(dict(step[q]))
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = twin
                q = twin
            link[new] = q
        last = new
    at = length = 0
    best = (0, 0, 0)
    for i, c in enumerate(a):
        while at and c not in step[at]:
            at = link[at]
            length = size[at]
        if c in step[at]:
            at, length = step[at][c], length + 1
        if length > best[2]:
            best = (i - length + 1, ends[at] - length + 1, length)
    return best


def ratio(a: str, b: str) -> float:
    """Twice the characters in matching pieces over all characters: the longest piece first, then those before and behind it. Two empty texts are equal."""
    matched, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        i, k, j, m = todo.pop()
        if i == k or j == m:
            continue
        x, y, n = _longest(a[i:k], b[j:m])
        if n:
            matched += n
            todo += [(i, i + x, j, j + y), (i + x + n, k, j + y + n, m)]
    return 2 * matched / (len(a) + len(b)) if a or b else 1.0


def _lines(text: str) -> list[str]:
    return text.split("\n")[:-1] if text.endswith("\n") else text.split("\n") if text else []


def compared(old: Column, new: Column, with_ratio: bool = True) -> Column:
    """(added, removed, kept, script, ratio) of two texts; null counts as empty, lines end with \\n.

    Time grows with the product of both numbers of lines over the size of a
    machine word; the ratio's with the characters, times how often pieces
    split, so it can be left out (null).
    """

    def run(one: pd.Series, two: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(one.fillna(""), two.fillna(""), strict=True):
            steps = script(_lines(x), _lines(y))
            of = lambda op: [line for o, line in steps if o == op]  # noqa: E731, B023
            rows.append((of("+"), of("-"), of(" "), [{"op": o, "line": line} for o, line in steps], ratio(x, y) if with_ratio else None))
        return pd.DataFrame(rows, columns=["added", "removed", "kept", "script", "ratio"]).astype({"ratio": "Float64"})

    run.__annotations__ = {"one": pd.Series, "two": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, RESULT)(old, new)
