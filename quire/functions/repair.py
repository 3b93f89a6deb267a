"""Repair of almost-JSON answers, as an Arrow-batched UDF for the rows that no built-in parses."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def repair_value(text: str | None) -> str | None:
    """JSON made from ``text`` by closing open strings and brackets and dropping dangling commas and keys; null if that fails.

    The text is read once; of a cut-off answer everything up to the last whole element is kept. A null or
    bracketless text is null.
    """
    if text is None:
        return None
    start = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if start < 0:
        return None
    closers, inside, escaped, out = [], False, False, []
    whole: list[tuple[int, list[str]]] = []  # places after whole elements, with the brackets open there
    for c in text[start:]:
        if inside:
            out.append(c)
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                inside = False
                whole.append((len(out), closers[:]))
            continue
        if c == '"':
            inside = True
        elif c in "{[":
            closers.append("}" if c == "{" else "]")
        elif c in "}]":
            if not closers or closers[-1] != c:
                continue
            while out and (out[-1].isspace() or out[-1] == ","):
                out.pop()
            closers.pop()
        out.append(c)
        if c in "}]{[" or c.isalnum():
            whole.append((len(out), closers[:]))
        if not closers:
            break
    for at, open_ in [(len(out), closers), *reversed(whole[-400:])]:
        cut = "".join(out[:at]) + ('"' if inside and at == len(out) else "")
        candidate = cut.rstrip().rstrip(",") + "".join(reversed(open_))
        try:
            json.loads(candidate)
        except ValueError:
            continue
        return candidate
    return None


@F.pandas_udf(StringType())
def repair_json(text: pd.Series) -> pd.Series:
    return text.map(repair_value)
