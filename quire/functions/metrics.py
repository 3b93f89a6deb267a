"""Text-distance functions that no built-in expresses, as Arrow-batched UDFs."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


MOST_LEVELS = 64


def _levels(a: Sequence, places: dict) -> list[tuple[list[int], dict[int, list[int]]]] | None:
    """At n - 1: where in ``a`` runs of n elements start that ``places`` has too, and where those are; none if runs are longer than ``MOST_LEVELS``."""
    level = {i: places[x] for i, x in enumerate(a) if x in places}
    out = []
    while level:
        if len(out) == MOST_LEVELS:
            return None
        out.append((list(level), level))
        longer = {}
        for i, own in level.items():
            if after := level.get(i + 1):
                after = set(after)
                if own := [j for j in own if j + 1 in after]:
                    longer[i] = own
        level = longer
    return out


def _edits(a: Sequence, b: Sequence) -> int:
    """Edits of ``difflib.SequenceMatcher(None, a, b).get_opcodes()``, a replacement counting the longer side.

    The blocks are those of difflib, without its elements of over 1 % of a long ``b``. Its longest block of a part is the first
    start of a run of the most elements. Left of it there is no run as long, right of it none longer, so that no start is
    tried twice for one length; difflib reads the whole part for each block. Where runs are long and so blocks few, parts are read too.
    """
    places: dict = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    if len(b) >= 200:
        places = {x: own for x, own in places.items() if len(own) <= len(b) // 100 + 1}
    levels = _levels(a, places)
    held = [] if levels else [i for i, x in enumerate(a) if x in places]
    todo, blocks = [(0, len(a), 0, len(b), len(levels or ()))], [(len(a), len(b), 0)]
    while todo:
        a0, a1, b0, b1, most = todo.pop()
        i, j, size = a0, b0, 0
        while most and not size:
            starts, there = levels[most - 1]
            for at in range(bisect_left(starts, a0), bisect_right(starts, a1 - most)):
                own = there[starts[at]]
                first = bisect_left(own, b0)
                if first < len(own) and own[first] + most <= b1:
                    i, j, size = starts[at], own[first], most
                    break
            else:
                most -= 1
        if levels is None:
            lengths, last = {}, -2
            for at in range(bisect_left(held, a0), bisect_left(held, a1)):
                x = held[at]
                before = lengths if x == last + 1 else {}
                lengths, last = {}, x
                own = places[a[x]]
                for y in own[bisect_left(own, b0) : bisect_left(own, b1)]:
                    n = lengths[y] = before.get(y - 1, 0) + 1
                    if n > size:
                        i, j, size = x - n + 1, y - n + 1, n
        while i > a0 and j > b0 and a[i - 1] == b[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < a1 and j + size < b1 and a[i + size] == b[j + size]:
            size += 1
        if size:
            blocks.append((i, j, size))
            if a0 < i and b0 < j:
                todo.append((a0, i, b0, j, max(most - 1, 0)))
            if i + size < a1 and j + size < b1:
                todo.append((i + size, a1, j + size, b1, most))
    edits = i = j = 0
    for x, y, size in sorted(blocks):
        edits += max(x - i, y - j)
        i, j = x + size, y + size
    return edits


def _opcode_rate(predicted: Sequence, truth: Sequence) -> float:
    """Edits of a difflib alignment, a replacement counting the longer side, over the length of the truth."""
    if predicted == truth:
        return 0.0
    if not truth or not predicted:
        return 1.0
    return _edits(truth, predicted) / len(truth)


def cer_value(predicted: str | None, truth: str | None) -> float:
    return _opcode_rate(" ".join((predicted or "").split()), " ".join((truth or "").split()))


def wer_value(predicted: str | None, truth: str | None) -> float:
    return _opcode_rate((predicted or "").split(), (truth or "").split())


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence by bit-parallel rows held in one integer."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & places.get(c, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def similarity_value(a: str | None, b: str | None) -> float:
    """Normalised indel similarity 2 * LCS / (m + n)."""
    a, b = a or "", b or ""
    if not a and not b:
        return 1.0
    return 2 * lcs_length(a, b) / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def cer(predicted: pd.Series, truth: pd.Series) -> pd.Series:
    return pd.Series([cer_value(p, t) for p, t in zip(predicted, truth, strict=True)])


@F.pandas_udf(DoubleType())
def wer(predicted: pd.Series, truth: pd.Series) -> pd.Series:
    return pd.Series([wer_value(p, t) for p, t in zip(predicted, truth, strict=True)])


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity_value(x, y) for x, y in zip(a, b, strict=True)])


def cer_levenshtein(predicted, truth):
    """Edit distance over the length of the truth, a metric of its own."""
    return F.when(F.length(truth) == 0, F.when(F.length(predicted) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(predicted, truth) / F.length(truth))


def all_metrics(predicted, truth):
    """Struct of the distances and of both lengths."""
    from .text import word_count

    return F.struct(
        cer(predicted, truth).alias("cer"), wer(predicted, truth).alias("wer"), similarity(predicted, truth).alias("similarity"),
        F.length(predicted).alias("predicted_length"), F.length(truth).alias("truth_length"),
        word_count(predicted).alias("predicted_words"), word_count(truth).alias("truth_words")
    )
